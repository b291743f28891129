"""Components against all pairs, on the tables and on families of near copies."""

import random

import numpy as np
import pytest
from brute import components_by_brute_force, shingle_set

from tessera.llm import ngramjoin
from tessera.llm.queries import op1_ngram_join


def result(df, n, percent):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.cluster(df, n, percent).collect()}


def test_query_equals_brute_force(spark, sf_dir):
    got = op1_ngram_join(spark, sf_dir).collect()
    docs = [tuple(r)[:2] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert len(got) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_by_brute_force(docs, 4, 85)


def families(seed, families, members, words, edits):
    """Texts of a family share most words; a family's sets have many common shingles."""
    r, docs = random.Random(seed), []
    for f in range(families):
        base = [f"w{r.randint(0, 400)}" for _ in range(words)]
        for _ in range(members):
            own = list(base)
            for _ in range(r.randint(0, edits)):
                own[r.randrange(len(own))] = f"x{r.randint(0, 10**6)}"
            docs.append(" ".join(own[r.randint(0, 3) :]))
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("n,percent,seed", [(5, 80, 2), (3, 60, 3)])
def test_families_with_every_index_class_and_tiles(spark, monkeypatch, n, percent, seed):
    """Small bounds make frequent shingles, hot signatures and tiles of these texts."""
    monkeypatch.setattr(ngramjoin, "FREQUENT", 2)
    monkeypatch.setattr(ngramjoin, "VERY_FREQUENT", 6)
    monkeypatch.setattr(ngramjoin, "SMALL", 3)
    monkeypatch.setattr(ngramjoin, "TILE_BLOCK", 8)
    docs = families(seed, 5, 40, 150, 14)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert result(df, n, percent) == components_by_brute_force(docs, n, percent)


@pytest.mark.parametrize("packet", [2000, 9000])
def test_shingles_that_all_texts_share_and_packets_of_any_size(spark, monkeypatch, packet):
    """Boilerplate in every text, over many small packets; large packets have wide positions."""
    monkeypatch.setattr(ngramjoin, "PACKET", 2000)
    monkeypatch.setattr(ngramjoin, "packing", lambda size, own, bucket, least: (packet, 7))
    docs = [(i, "all texts begin with these same eight words " + t) for i, t in families(5, 30, 6, 60, 5)] + [(9000 + i, "all texts begin with these same eight words") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert result(df, 4, 85) == components_by_brute_force(docs, 4, 85)


def test_a_hot_shingle_is_one_entry_of_a_packet():
    shingles, sets = np.full(5000, 7 << 40, np.uint64), np.arange(5000, dtype=np.uint16)
    own = np.arange(1, 5001, dtype=np.uint64) << np.uint64(50)
    rows, folded = ngramjoin._pack(np.concatenate([shingles, own]), np.concatenate([sets, sets]), 9)
    assert sum(len(x[3]) for x in rows.values()) == 12 and sum(len(x[2] or b"") for x in rows.values()) == 2 * 5000
    assert folded[0].tolist() == [7 << 24] and folded[1].tolist() == [5000] and sorted(folded[2].tolist()) == list(range(5000))


@pytest.mark.parametrize("percent,least", [(85, 6), (80, 4), (50, 1), (100, np.inf)])
def test_smaller_sets_have_no_links(percent, least):
    assert ngramjoin.smallest_linked(percent) == least
    assert all((100 * n >= percent * (n + 1)) == (n >= least) for n in range(1, 50))


def test_link_counts_of_families(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "TILE_BLOCK", 8)
    monkeypatch.setattr(ngramjoin, "LINK_BLOCK", 8)
    docs = families(7, 4, 30, 120, 10)
    docs += [(1000 + i, t) for i, t in docs[:20]] + [(5000, None)]
    sets = {i: shingle_set(t, 4) for i, t in docs}
    different = set(sets.values())
    want = {i: sum(s != o and 100 * len(s & o) >= 85 * len(s | o) for o in different if o) if s else 0 for i, s in sets.items()}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.n_links for r in ngramjoin.link_counts(df, 4, 85).collect()} == want and max(want.values()) > 5


def test_links_query_equals_brute_force(spark, sf_dir, tmp_path):
    from tessera.llm.queries import queries

    docs = [tuple(r)[:2] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()][:300]
    docs += [(100_000 + i, t) for i, t in families(8, 2, 40, 120, 10)] + [(200_000, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: shingle_set(t, 4) for i, t in docs}
    different = set(sets.values()) - {frozenset()}
    plain = components_by_brute_force(docs, 4, 85)
    want = {i: (*plain[i], sum(s != o and 100 * len(s & o) >= 85 * len(s | o) for o in different)) for i, s in sets.items()}
    got = queries()["op1_ngram_join"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == want and len(got) == len(docs)
    assert max(w[2] for w in want.values()) > 10


def test_signatures_of_similar_sets_meet():
    """Any two sets at the threshold share a signature, whatever their shingles' counts."""
    r = np.random.default_rng(9)
    for percent in (50, 80, 85, 95):
        for _ in range(150):
            n = int(r.integers(1, 400))
            ids = np.unique(r.integers(0, 1 << 48, 3 * n, dtype=np.uint64))
            counts = dict(zip(ids.tolist(), r.choice([2, 3, 20, 40, 300, 900], len(ids)).tolist(), strict=True))
            a = ids[r.permutation(len(ids))[:n]]
            lose = int(r.integers(0, n - int(np.ceil(percent * n / 100)) + 1))
            b = np.union1d(a[lose:], np.setdiff1d(ids, a)[: int(r.integers(0, 3))])
            shared = len(np.intersect1d(a, b))
            if 100 * shared < percent * (len(a) + len(b) - shared):
                continue
            found = []
            for s in (a, b):
                order = sorted(s.tolist(), key=lambda x: (counts[x], x))
                found.append(ngramjoin.signatures(np.array(order, np.uint64), np.array([counts[x] for x in order]), len(s), percent))
            assert len(np.intersect1d(*found))


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a B"), (6, "b a"), (7, "one two three four"), (7, "one two three four"), (8, "ONE two\x0bthree four "), (9, "one\xa0two three four")]
    df = spark.createDataFrame([(i, t, "x", i) for i, t in docs], "doc_id long, text string, component_id string, set_id long")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.cluster(df, 4, 85).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (7, 1, 7), (8, 1, 7), (9, 1, 9)]
    assert result(df.limit(0), 4, 85) == {}


def test_one_long_text(spark):
    r = random.Random(4)
    long = " ".join(f"w{r.randint(0, 9999)}" for _ in range(400_000))
    df = spark.createDataFrame([(1, long), (2, long + " tail"), (3, "short text of a few words")], "doc_id long, text string")
    assert {k: v[1] for k, v in result(df, 5, 80).items()} == {1: 1, 2: 1, 3: 3}


def test_query_equals_sql(spark, sf_dir):
    import duckdb

    from tessera.llm.queries import OP1_SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert {tuple(r) for r in op1_ngram_join(spark, sf_dir).select("doc_id", "n_shingles", "component_id", "n_links").collect()} == set(con.execute(OP1_SQL).fetchall())
