"""Encoding against the tiktoken library, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
pytest.importorskip("tokenizers")

from tessera.llm import bytebpe  # noqa: E402
from tessera.llm.queries import op2_byte_bpe  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")
PIECES = ["a", "B", "'s", "'S", " ", "  ", "\n", "\t", "\x0b", "\r", "\x1c", "\x85", "\xa0", " ", "᠎", "​", "é", "é", "ß", "中", "𝒳", "²", "\0", "_", "🙂", "<|endoftext|>", "'ll"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bytebpe.Codec(bytebpe.tokenizer_json(PATH, P.PATTERN))


def test_byte_table_is_reversible():
    assert sorted(bytebpe.character_bytes().values()) == list(range(256))
    assert bytebpe.byte_characters()[0x20] == "Ġ"


def test_same_ids_as_tiktoken_and_exact_round_trip(codec, reference):
    r = random.Random(7)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 14))) for _ in range(1500)]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
        assert "".join(codec.decode_stream(ids)) == text


@pytest.fixture(scope="module")
def fast():
    assert P.PATTERN == bytebpe.SPLIT
    return bytebpe.Codec(bytebpe.tokenizer_json(PATH, P.PATTERN), bytebpe.character_classes())


def test_pieces_equal_the_patterns(fast):
    """Many short texts at once, so that rows' ends and the pieces' rules meet in all ways."""
    import regex

    r, parts = random.Random(11), [*PIECES, "s", "t", "re", "ve", "l", "ll", "d", "m", "'", "''", "1", "12", ".", "\u3000", " \n", "L"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(20_000)]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    start = bytebpe.pieces_of(data, offsets, fast.classes).tolist()
    got = [data[a:z].tobytes().decode() for a, z in zip(start, [*start[1:], len(data)], strict=True)]
    assert got == [x for t in texts for x in regex.findall(P.PATTERN, t)]


def test_remembered_pieces_give_tiktokens_ids(fast, reference, monkeypatch):
    monkeypatch.setattr(bytebpe, "REMEMBERED", 50)
    r = random.Random(12)
    for _ in range(20):
        texts = ["".join(r.choice([*PIECES, "word", " the", "ing"]) for _ in range(r.randint(0, 30))) for _ in range(100)]
        assert fast.encode(texts) == [reference.encode_ordinary(t) for t in texts]


def test_pieces_of_one_hash_are_told_apart(fast, reference, monkeypatch):
    monkeypatch.setattr(bytebpe, "span_hashes", lambda data, a, z, lower: np.zeros(len(a), np.uint64))
    fast._forget()
    texts = ["the cat", "the the", "a b c"]
    column = __import__("pyarrow").array(texts)
    for t, (ids, decoded) in zip(texts, bytebpe.encoded_rows(fast, column), strict=True):
        assert ids.tolist() == reference.encode_ordinary(t) and decoded == t.encode()
    fast._forget()


def test_another_pattern_is_the_librarys(spark):
    df = spark.createDataFrame([(1, "a bc 12"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in bytebpe.encode(df, PATH, r"\S+|\s+", with_offsets=True).collect()}
    assert rows[2].ids == [] and rows[1].token_end[-1] == 7


def test_offsets_cover_split_characters(codec):
    text = "né 🙂x"
    ids = codec.encode([text])[0]
    start, end = codec.offsets(text, ids)
    assert start[0] == 0 and end[-1] == len(text)
    assert all(a < b for a, b in zip(start, end, strict=True))
    assert all(0 <= b2 - a1 for a1, b2 in zip(start[1:], end[:-1], strict=True))


def test_query_equals_brute_force(spark, sf_dir, reference):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op2_byte_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = reference.encode_ordinary(d.text or "")
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())
        assert got[d.doc_id] == want


def test_nulls_empties_and_other_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", None), (2, "", None), (None, "ab " * 70_000, "y")], "doc_id long, text string, n_tokens string")
    rows = bytebpe.round_trip(df, PATH, P.PATTERN).collect()
    assert sorted(r.n_tokens for r in rows)[:3] == [0, 0, 0] and len(rows) == 4
    coded = bytebpe.decode(bytebpe.encode(df, PATH, P.PATTERN, with_offsets=True), PATH, P.PATTERN).collect()
    assert all((r.text or "") == r.decoded_text for r in coded)
    kept = bytebpe.verified_round_trip(df, PATH, P.PATTERN).collect()
    assert len(kept) == 4 and sorted(str(r.text)[:2] for r in kept) == ["", "", "No", "ab"]
    assert bytebpe.round_trip(df.limit(0), PATH, P.PATTERN).collect() == []
