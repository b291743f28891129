"""The driver's contract, with and without the training-data subpackage."""

import sys

import __spark_entry__


def test_queries_have_their_sql_by_name():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_engine_stands_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "tessera.llm", None)
    found = __spark_entry__.queries()
    assert "dice" in found and "pipeline" not in found and not any(q.startswith("op") and q[2].isdigit() for q in found)
    assert set(__spark_entry__.oracle_sql()) <= set(found)
