"""Exact search, sharding and training order against plain code."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from tessera.llm import hashtree, shards, topk  # noqa: E402
from tessera.llm.components import components  # noqa: E402
from tessera.llm.queries import op7_hash_tree, op8_exact_topk, op10_training_order  # noqa: E402
from tessera.plans.runtime import Scratch  # noqa: E402


def plain_search(rows, k=5):
    vectors = {i: [math.floor(256 * float(x)) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, a in vectors.items():
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in vectors.items() if i != q and len(a) == len(b))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])}
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want = plain_search(rows)
    assert {tuple(r) for r in op8_exact_topk(spark, d).collect()} == want
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "FAN_IN", 2)
    assert {tuple(r) for r in op8_exact_topk(spark, d).collect()} == want


def test_search_ties_nulls_lengths_and_large_components(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (3, [1.0, 2.0]), (1, [1.0, 2.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (100, [1.0]), (8, [-3e12, 5e12]), (9, [1.0, 2.0]), (10, [1.0, 2.0]), (11, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.quantise(F.col("embedding")).alias("vector"), F.lit(1).alias("score"))
    got = {tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == plain_search(rows)
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_shards_sizes_checksums_and_growth(spark, sf_dir):
    rows = op7_hash_tree(spark, sf_dir).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key") and 0 <= r.shard < 24
        assert r.grown_shard in (r.shard, 24)
    for shard, n in Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))


def test_shares_follow_weights_and_moves_stay_in_changed_subtrees(spark):
    df = spark.range(60_000).withColumnRenamed("id", "doc_id")
    root = hashtree.tree(24, weights={3: 4.0, 5: 0.0})
    heavier = hashtree.tree(24, weights={3: 4.0, 5: 0.0, 20: 3.0})
    both = hashtree.place(hashtree.place(df, root, "doc_id", "a"), heavier, "doc_id", "b")
    n = Counter(r.a for r in both.collect())
    assert n[5] == 0 and n[3] / 60_000 == pytest.approx(4 / 26, rel=0.06) and n[0] / 60_000 == pytest.approx(1 / 26, rel=0.12)
    moved = [(r.a, r.b) for r in both.where("a <> b").collect()]
    assert moved and all(b // 8 == 2 for _, b in moved)  # only into the region whose weight grew
    assert all(b == 20 or b // 4 != a // 4 for a, b in moved)
    grown = hashtree.place(hashtree.place(df, root, "doc_id", "a"), hashtree.grown(root, 24), "doc_id", "b")
    assert {r.b for r in grown.where("a <> b").collect()} == {24}


def test_trees_of_more_shards_are_grown_ones_and_only_the_new_shard_gains(spark):
    df = spark.range(30_000).withColumnRenamed("id", "doc_id")
    for n in range(24, 27):
        df = hashtree.place(df, hashtree.tree(n), "doc_id", f"s{n}")
    df = hashtree.place(hashtree.place(df, hashtree.grown(hashtree.tree(24), 24), "doc_id", "g25"), hashtree.grown(hashtree.tree(25), 25), "doc_id", "g26")
    rows = df.collect()
    assert all(r.g25 == r.s25 and r.g26 == r.s26 for r in rows)
    for a, b in ((24, 25), (25, 26)):
        moved = [r[f"s{b}"] for r in rows if r[f"s{a}"] != r[f"s{b}"]]
        assert set(moved) == {a} and len(moved) / len(rows) == pytest.approx(1 / b, rel=0.15)


def test_query_equals_a_plain_descent(spark, sf_dir):
    """The tree as nested lists, descended key by key with Spark's hash in plain code."""

    def rotate(x, n):
        return (x << n | x >> 64 - n) & M

    M, P1, P2, P3, P4, P5 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5

    def xxh64(data, seed):
        at, n = 0, len(data)
        if n >= 32:
            v = [(seed + P1 + P2) & M, (seed + P2) & M, seed, (seed - P1) & M]
            while at + 32 <= n:
                for k in range(4):
                    v[k] = rotate((v[k] + int.from_bytes(data[at + 8 * k : at + 8 * k + 8], "little") * P2) & M, 31) * P1 & M
                at += 32
            h = (rotate(v[0], 1) + rotate(v[1], 7) + rotate(v[2], 12) + rotate(v[3], 18)) & M
            for x in v:
                h = ((h ^ rotate(x * P2 & M, 31) * P1 & M) * P1 + P4) & M
        else:
            h = (seed + P5) & M
        h = (h + n) & M
        while at + 8 <= n:
            h = (rotate(h ^ rotate(int.from_bytes(data[at : at + 8], "little") * P2 & M, 31) * P1 & M, 27) * P1 + P4) & M
            at += 8
        if at + 4 <= n:
            h = (rotate(h ^ int.from_bytes(data[at : at + 4], "little") * P1 & M, 23) * P2 + P3) & M
            at += 4
        for b in data[at:]:
            h = rotate(h ^ b * P5 & M, 11) * P1 & M
        h = (h ^ h >> 33) * P2 & M
        h = (h ^ h >> 29) * P3 & M
        return h ^ h >> 32

    def draw(key, name, weight):
        h = xxh64(name.encode(), xxh64(key.encode(), 42))
        return math.log(((h >> 12) + 0.5) / 2**52) / weight

    def descend(key, node):
        name, children = node
        if isinstance(children, int):
            return children
        weigh = lambda n: 1.0 if isinstance(n[1], int) else sum(map(weigh, n[1]))
        return descend(key, max(children, key=lambda c: draw(key, c[0], weigh(c))))

    regions = [(f"region{g}", [(f"rack{2 * g + k}", [(f"shard{8 * g + 4 * k + i}", 8 * g + 4 * k + i) for i in range(4)]) for k in range(2)]) for g in range(3)]
    more = [*regions, ("region-of-shard24", [("rack-of-shard24", [("shard24", 24)])])]
    for r in op7_hash_tree(spark, sf_dir).collect():
        assert (r.shard, r.grown_shard) == (descend(str(r.doc_id), ("root", regions)), descend(str(r.doc_id), ("root", more)))


def test_sharding_nulls_repeats_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(hashtree, "ROWS_A_PART", 7)
    rows = [(n % 90, "t" * (n % 5) if n % 7 else None, "x") for n in range(200)] + [(None, "a", "y")]
    out = hashtree.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, slot string")).collect()
    assert len(out) == 201 and len({(r.doc_id, r.shard) for r in out}) == 91
    for shard in {r.shard for r in out}:
        own = [r.slot for r in out if r.shard == shard]
        assert sorted(own) == list(range(len(own)))
    assert hashtree.shard_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    plan = hashtree.place(spark.range(5).withColumnRenamed("id", "doc_id"), hashtree.tree(24), "doc_id")._jdf.queryExecution().toString()
    assert "Python" not in plan


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_slots_are_a_permutation(n):
    assert sorted(shards.slots(np.arange(n), n, 7).tolist()) == list(range(n))
    assert n < 100 or (shards.slots(np.arange(n), n, 7) != shards.slots(np.arange(n), n, 8)).mean() > 0.9


def test_training_order_equals_plain_order_and_reads_resume(spark, sf_dir, tmp_path):
    import base64

    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = Counter()
    for r in docs.collect():
        ids = encoding.encode_ordinary(r.text or "")
        want.update((r.doc_id, k // 64, tuple(ids[k : k + 64])) for k in range(0, len(ids), 64))
    ordered = shards.in_training_order(docs, path, P.PATTERN, length=64, shard_rows=100).cache()
    rows = ordered.collect()
    assert sorted(r.slot for r in rows) == list(range(sum(want.values())))
    assert Counter((r.doc_id, r.part, tuple(np.frombuffer(r.tokens, "<u2")[: r.n_tokens].tolist())) for r in rows) == want
    assert all(r.shard == r.slot // 100 and r.offset == r.slot % 100 * 128 for r in rows)
    folder = str(tmp_path / "shards")
    assert sum(r.n_sequences for r in shards.write_shards(ordered, folder, 64, 100).collect()) == len(rows)
    by_slot = {r.slot: np.frombuffer(r.tokens, "<u2")[: r.n_tokens].tolist() for r in rows}
    start = 257
    read = [(s, ids.tolist()) for s, ids in shards.read_from(folder, start, 64, 100)]
    assert read == [(s, by_slot[s]) for s in range(start, len(rows))]


def test_training_order_query_nulls_and_empty(spark, sf_dir):
    rows = op10_training_order(spark, sf_dir).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    path = P.path("byte_bpe_50k.tiktoken")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c")], "doc_id long, text string")
    got = shards.in_training_order(odd, path, P.PATTERN).collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "3", "None"] and sorted(r.slot for r in got) == [0, 1, 2]
    assert shards.in_training_order(odd.limit(0), path, P.PATTERN).collect() == []


def test_training_order_query_writes_every_shard(spark, sf_dir, monkeypatch):
    import hashlib
    import os
    from urllib.parse import urlparse

    monkeypatch.setattr(shards, "WAVES", 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = P.path("byte_bpe_50k.tiktoken")
    plain = {r.slot: r for r in shards.in_training_order(docs, path, P.PATTERN).collect()}
    for rows, shard_rows in ((op10_training_order(spark, sf_dir).collect(), shards.SHARD_ROWS), (shards.materialise(docs, path, P.PATTERN, shard_rows=20).collect(), 20)):
        assert sorted(r.slot for r in rows) == sorted(plain)
        files = {r.shard: urlparse(r.shard_file).path for r in rows}
        assert len(files) == -(-len(rows) // shard_rows)
        raw = {s: open(f, "rb").read() for s, f in files.items()}
        assert sum(map(len, raw.values())) == len(rows) * 1024
        for r in rows:
            own = raw[r.shard][r.offset : r.offset + 1024]
            assert own == plain[r.slot].tokens and r.tokens_sha256 == hashlib.sha256(own).hexdigest()
            assert r.shard_bytes == len(raw[r.shard]) and (r.doc_id, r.part, r.n_tokens) == (plain[r.slot].doc_id, plain[r.slot].part, plain[r.slot].n_tokens)
        folder = os.path.dirname(files[0])
        assert sorted(os.listdir(folder)) == sorted(map(os.path.basename, files.values()))
        assert [s for s, _ in shards.read_from(folder, 3, shards.LENGTH, shard_rows)] == list(range(3, len(rows)))
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert shards.materialise(odd, path, P.PATTERN).collect() == []


def test_components(spark):
    r = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {x.node: x.label for x in components(df, Scratch(spark, "t"), "c").collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(df.limit(0), Scratch(spark, "t"), "c").count() == 0
