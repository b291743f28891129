"""Registered queries: each operator on the driver's tables, with equivalent SQL."""

from tessera.queries import cohort, files, geometry, grids, models, statistics, volumes

MODULES = (volumes, cohort, statistics, geometry, grids, models, files)


def queries():
    return {k: f for m in MODULES for k, (f, _) in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, (_, s) in m.QUERIES.items() if s}
