"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is a file of ranks (base64 token, rank), never trained here. Bytes are
written as characters by the usual reversible table (printable Latin-1 bytes stand for
themselves, the rest for code points from 256 on), so that a string library can merge
bytes; decoding reverses the table.

A pattern parts a text into pieces that are merged each by itself. Pieces of ``SPLIT``, the
usual pattern, are found for a whole batch at once from the characters' classes, which the
library's own expressions tell; the library then encodes each different piece, and a worker
remembers the pieces it met. Other patterns are left to the library.

Cases: a null or empty text has no ids and decodes to no bytes; special-token strings in a
text are ordinary text; texts of any length are never cut; repeated rows give repeated results; other
columns pass through, and where one has the name of a new column the new one replaces it.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.labelled import pieces
from tessera.llm.textkernel import span_hashes
from tessera.plans.runtime import ship

#: Fixed value: the pattern of the published vocabularies of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Classes of characters; all others are 0.
LETTER, NUMBER, SPACE = 1, 2, 3
#: Pieces, and bytes of pieces, that a worker remembers before it begins anew.
REMEMBERED, REMEMBERED_BYTES = 1 << 19, 16 << 20
#: Rows whose ids are one Arrow batch.
SLICE = 256


@lru_cache(1)
def byte_characters() -> list[str]:
    """The character that stands for each byte."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    shown = {b: chr(b) for b in plain}
    return [shown.get(b) or chr(256 + b - sum(p < b for p in plain)) for b in range(256)]


@lru_cache(1)
def character_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_characters())}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token to rank, as a ranks file has them."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _parents(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens whose merge makes this one: what lower ranks alone leave of it."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        found = [(ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        rank, i = min(found)
        if rank >= own:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@lru_cache(4)
def tokenizer_json(path: str, pattern: str) -> str:
    """The tokenizer for a ranks file and a split pattern, as the library serialises it."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, shown = load_ranks(path), byte_characters()
    spell = lambda token: "".join(shown[b] for b in token)
    merges = [
        tuple(map(spell, pair))
        for token in sorted(ranks, key=ranks.__getitem__)
        if len(token) > 1 and (pair := _parents(token, ranks))
    ]
    made = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges))
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return made.to_str()


@lru_cache(1)
def character_classes() -> np.ndarray:
    """The class of each code point, as the library's expressions have it."""
    from tokenizers import Regex, pre_tokenizers

    out, block = np.zeros(0x110000, np.uint8), 2048
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        rest = pre_tokenizers.Split(Regex(pattern), "removed")
        for a in range(0, len(out), block):
            if not 0xD800 <= a < 0xE000:  # surrogates are no characters
                hit = np.ones(block, bool)
                for _, (x, y) in rest.pre_tokenize_str("".join(map(chr, range(a, a + block)))):
                    hit[x:y] = False
                out[a : a + block][hit] = kind
    return out


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points of characters whose UTF-8 begins at ``at``."""
    wide = np.concatenate([data, np.zeros(3, np.uint8)])
    b0, b1, b2, b3 = (wide[at + n].astype(np.int32) for n in range(4))
    low = lambda b: b & 0x3F
    long = np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | low(b1) << 6 | low(b2), (b0 & 0x07) << 18 | low(b1) << 12 | low(b2) << 6 | low(b3))
    return np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | low(b1), long))


def pieces_of(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where in the rows' UTF-8 bytes the pieces of ``SPLIT`` begin.

    A piece is a run of characters of one class, with the blank before it if there is one.
    Of a run of white space the last character is a piece of its own or that blank, unless
    the text ends there. An apostrophe by itself takes the ending after it.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)  # characters
    if not len(at):
        return at
    lead = data[at]
    kind = classes[:256][lead]
    high = np.flatnonzero(lead >= 0x80)
    kind[high] = classes[_code_points(data, at[high])]
    row = np.zeros(len(at) + 1, bool)  # where a row begins, or the bytes end
    row[np.searchsorted(at, offsets)] = True
    change = row.copy()
    change[1:-1] |= kind[1:] != kind[:-1]
    blank_before = np.zeros(len(at), bool)
    blank_before[1:] = lead[:-1] == 0x20
    blank_before &= ~row[:-1]
    space = kind == SPACE
    start = change[:-1] & (space | ~blank_before)
    start |= space & change[1:] & ~row[1:]
    mark = np.flatnonzero(change[:-1] & ~blank_before & (lead == 0x27) & change[1:] & ~row[1:])
    if len(mark):
        ends = np.append(lead, np.uint8(0))
        one, two = ends[mark + 1], np.where(row[np.minimum(mark + 2, len(at))], 0, ends[np.minimum(mark + 2, len(at))])
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, np.where(pair, 2, 0))
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        after = mark + 1 + size
        start[after[~change[after]]] = True  # the rest of the letters
    return at[start]


class Codec:
    """Encodes and decodes in one process, from a tokenizer's serialised form, and with
    characters' classes if its pattern is ``SPLIT``."""

    def __init__(self, serialised: str, classes: np.ndarray | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.classes = Tokenizer.from_str(serialised), classes
        if classes is not None:  # what it gets are pieces
            self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocab = json.loads(serialised)["model"]["vocab"]
        back = character_bytes()
        self.token_bytes: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        self.token_lengths = np.array([len(t) for t in self.token_bytes], dtype=np.int64)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.known_bytes, self.ids, self.first = 0, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _merged(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged_pieces(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has: their bytes end where it ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([[x.decode() for x in found]], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32)
        past = np.searchsorted(np.cumsum(self.token_lengths[ids]), np.cumsum([len(x) for x in found])) + 1
        return ids, np.diff(past, prepend=0)

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.classes is None:
            return self._merged(texts)
        return [x.tolist() for data, offsets in pieces(pa.array(texts, pa.string())) for x in self.rows(data, offsets)]

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each row of UTF-8 bytes."""
        raw = data.tobytes()
        if self.classes is None:
            return [np.array(x, np.int32) for x in self._merged([raw[a:z].decode() for a, z in zip(offsets, offsets[1:], strict=False)])]
        start = pieces_of(data, offsets, self.classes)
        if not len(start):
            return [np.zeros(0, np.int32)] * (len(offsets) - 1)
        end = np.append(start[1:], len(data))
        _, some, each = np.unique(span_hashes(data, start, end, lower=False), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED or self.known_bytes > REMEMBERED_BYTES:
            self._forget()
        own = [raw[a:z] for a, z in zip(start[some].tolist(), end[some].tolist(), strict=True)]
        if new := [x for x in own if x not in self.known]:
            ids, counts = self._merged_pieces(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.known_bytes += sum(map(len, new))
            self.ids = np.concatenate([self.ids, ids])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
        place = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))[each]
        counts = self.first[place + 1] - self.first[place]
        done = np.concatenate([[0], np.cumsum(counts)])
        flat = self.ids[np.repeat(self.first[place] - done[:-1], counts) + np.arange(done[-1])]
        cuts = done[np.searchsorted(start, offsets)]
        found = [flat[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]
        return found

    def exact(self, ids: np.ndarray, text: bytes) -> tuple[np.ndarray, bytes]:
        """The ids and their bytes; if these are not the text's, as two pieces of a batch had
        one hash, ids from its pieces one by one."""
        decoded = self.decode(ids.tolist())
        if decoded != text and self.classes is not None:
            at = pieces_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]), self.classes).tolist()
            ids, _ = self._merged_pieces([text[a:z] for a, z in zip(at, [*at[1:], len(text)], strict=True)])
            decoded = self.decode(ids.tolist())
        return ids, decoded

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-end character of each token; a token that has part of a
        character's bytes covers that character."""
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80)  # 1-based character of each byte
        end = np.cumsum(self.token_lengths[np.asarray(ids, dtype=np.int64)])
        begin = end - self.token_lengths[np.asarray(ids, dtype=np.int64)]
        return (char[begin] - 1, char[end - 1]) if len(end) else (begin, end)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode_text(self, ids) -> str:
        return self.decode(ids).decode("utf-8", errors="replace")

    def decode_stream(self, ids) -> Iterator[str]:
        """Text piece by piece; a character split over tokens comes with its last one."""
        held = codecs.getincrementaldecoder("utf-8")(errors="replace")
        for i in ids:
            if piece := held.decode(self.token_bytes[i]):
                yield piece
        if rest := held.decode(b"", final=True):
            yield rest


_codecs: dict[str, Codec] = {}


def shared_codec(df: DataFrame, path: str, pattern: str):
    """What gives a process its codec; the serialised tokenizer travels as a broadcast of
    the vocabulary's fixed size, and the classes as one of the code points' number."""
    spark = df.sparkSession
    ship(spark)
    serialised = tokenizer_json(path, pattern)
    key = hashlib.sha256(serialised.encode()).hexdigest()
    sent = spark.sparkContext.broadcast((serialised, character_classes() if pattern == SPLIT else None))

    def get() -> Codec:
        if key not in _codecs:
            _codecs[key] = Codec(*sent.value)
        return _codecs[key]

    return get


def encoded_rows(codec: Codec, column: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
    """Each text's ids, and the bytes that they decode to."""
    for data, offsets in pieces(column):
        raw, found = data.tobytes(), codec.rows(data, offsets)
        for a, z, ids in zip(offsets.tolist(), offsets[1:].tolist(), found, strict=False):
            yield codec.exact(ids, raw[a:z])


def _over_batches(df: DataFrame, fields: list[T.StructField], work, dropped: set[str]) -> DataFrame:
    """Each row with new columns that ``work`` makes from a slice of its batch."""
    names = {f.name for f in fields} | dropped
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *fields])
    kept_names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            yield from work(batch, kept_names)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", with_offsets: bool = False) -> DataFrame:
    """Add ``ids`` (array of int) and, if asked for, ``token_start`` and ``token_end`` in
    characters."""
    shared = shared_codec(df, path, pattern)
    ints = T.ArrayType(T.IntegerType())
    fields = [T.StructField("ids", ints)]
    if with_offsets:
        fields += [T.StructField("token_start", ints), T.StructField("token_end", ints)]
    lists = lambda found: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found]), pa.int32()))

    def work(batch: pa.RecordBatch, kept: list[str]):
        codec = shared()
        for a in range(0, len(batch), SLICE):
            part = batch.slice(a, SLICE)
            ids = [x for x, _ in encoded_rows(codec, part.column(text))]
            new = {"ids": lists(ids)}
            if with_offsets:
                found = [codec.offsets(t or "", x) for t, x in zip(part.column(text).to_pylist(), ids, strict=True)]
                new["token_start"], new["token_end"] = (lists([f[n] for f in found]) for n in (0, 1))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *new.values()], [*kept, *new])

    return _over_batches(df, fields, work, set())


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (the bytes) and ``decoded_text`` (bytes that are no UTF-8 replaced)."""
    shared = shared_codec(df, path, pattern)
    fields = [T.StructField("decoded", T.BinaryType()), T.StructField("decoded_text", T.StringType())]

    def work(batch: pa.RecordBatch, kept: list[str]):
        codec = shared()
        raw = [codec.decode(x or []) for x in batch.column(ids).to_pylist()]
        new = [pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", errors="replace") for x in raw], pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *new], [*kept, "decoded", "decoded_text"])

    return _over_batches(df, fields, work, set())


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Encode, then decode the ids; in place of the text: ``n_tokens``, ``ids_sha256``
    (ids as little-endian unsigned 32-bit integers) and ``decoded_sha256``.

    Both directions in one pass, so that ids need not travel between processes.
    """
    shared = shared_codec(df, path, pattern)
    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]

    def work(batch: pa.RecordBatch, kept: list[str]):
        codec = shared()
        n, of_ids, of_bytes = [], [], []
        for ids, decoded in encoded_rows(codec, batch.column(text)):
            n.append(len(ids))
            of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            of_bytes.append(hashlib.sha256(decoded).hexdigest())
        new = [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *new], [*kept, *(f.name for f in fields)])

    return _over_batches(df, fields, work, {text})


def verified_round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Rows whose text comes back byte for byte, with ``n_tokens``, the digests and the text."""
    keyed = df.select(text, F.struct(*df.columns).alias("_row"))
    coded = round_trip(keyed.select(text, "_row"), path, pattern, text)
    same = F.col("decoded_sha256") == F.sha2(F.coalesce(F.col(f"_row.`{text}`"), F.lit("")).cast("binary"), 256)
    return coded.where(same).select("_row.*", *(coded[c] for c in ("n_tokens", "ids_sha256", "decoded_sha256") if c not in df.columns))
