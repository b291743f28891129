"""Every registered query of the engine's own operators against its SQL, on the small tables."""

import math

import duckdb
import pytest

from tessera import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf_dir, oracle, name):
    df = queries.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr([_plain(r[c]) for c in cols]) for r in df.collect())
    cursor = oracle.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    rows = cursor.fetchall()
    assert sorted(names) == cols
    want = sorted(repr([_plain(r[names.index(c)]) for c in cols]) for r in rows)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["gmm_responsibilities", "normal_pdf"])
def test_every_voxel_is_returned(spark, sf_dir, oracle, name):
    n = oracle.execute("SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL").fetchone()[0]
    assert queries.queries()[name](spark, sf_dir).select("vec_id", "i", "j", "k").distinct().count() == 64 * n
