"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct word n-grams; two link when the Jaccard similarity
of their sets reaches a percentage. Equal sets are one set from the start. Then:

1. *Counting.* Shingle ids go to buckets of the id range, packed as arrays; a bucket finds
   the ids that more than one set holds and returns only those, with their counts. An id
   that several sets of a packet hold is one entry there, so a shingle that all documents
   share is a few entries a packet. A set with too few shared ids can have no link and is
   gone, and so is from the start one so small that a shingle more or less is too many.
2. *Prefixes.* A set's shingles are ordered by count, rare ones first. Rare shingles are
   indexed alone, frequent ones in pairs and very frequent ones in triples, within groups
   that a hash gives. A prefix is extended until a similar set must share one of these
   signatures: with ``e`` the most shingles that a linked set may lack, all but ``e`` of
   the prefix are shared, and at most ``k - 1`` shared ones of a group of k-combinations
   make no signature. Groups depend on the size's power of two; a set whose partners may
   lie beyond the next power signs for that one too.
3. *Verification.* Sets that share a signature are held against the signature's smallest
   set. Signatures whose sets are not all connected by then give the pairs of sets of
   different components: by a self-join where they are few, else in tiles of bounded size
   over groups of connected signatures. Every pair that shares a signature is thus either
   verified exactly or already connected, so the components are exact.

Shingle ids are 48-bit hashes of whole n-grams, set ids 64-bit hashes of whole sets. Sets
that are compared have at least percent / (100 - percent) shingles, most of which must be
equal, so that equal hashes of different n-grams make no link.

Cases: without words (or text) a document has size 0, no links and is its own component;
with fewer than n words its whole sequence is its one shingle; repeated rows and equal
texts are one component; a null id groups like any other; a text of any length is one set
of all its n-grams; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import pickle
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.labelled import pieces
from tessera.llm.packing import bucket_runs, packing
from tessera.llm.textkernel import distinct_by_row, mix, shingles, word_hashes
from tessera.plans.runtime import Scratch, ship, shuffle_partitions

#: Shingles packed together before they are dealt to buckets; sets in a packet at most.
PACKET, PACKET_SETS = 1_000_000, 60_000
#: Text bytes whose shingles share a bucket, about.
BUCKET_BYTES = 8 << 20
#: Sets of a packet from which on their common shingle is one entry for its bucket.
FOLD = 4
#: Counts above which shingles are indexed in pairs and in triples.
FREQUENT, VERY_FREQUENT = 16, 256
#: Signatures with more sets than this are resolved in tiles of at most two blocks; sets of a
#: block where all links are counted.
SMALL, TILE_BLOCK, LINK_BLOCK = 64, 256, 512
ID_SHIFT, LOW = np.uint64(16), np.uint64(32)


def sets_of(texts, n: int):
    """Yield for runs of texts: set ids, set sizes, distinct shingles, first of each row."""
    for data, offsets in pieces(texts):
        found, first = distinct_by_row(*shingles(*word_hashes(data, offsets), n))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(found), dtype=np.uint64)])
        sizes = np.diff(first)
        ids = mix(sums[first[1:]] - sums[first[:-1]] + sizes.astype(np.uint64))
        yield ids, sizes, found, first


def describe(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    """In place of the text: ``set_id`` (null without words) and ``n_shingles``."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, "set_id", "n_shingles")]
    schema = docs.select(*kept).schema.add("set_id", "long").add("n_shingles", "long")

    def run(batches):
        for batch in batches:
            found = [(i, s) for i, s, _, _ in sets_of(batch.column(text), n)]
            ids = np.concatenate([i for i, _ in found]) if found else np.zeros(0, np.uint64)
            sizes = np.concatenate([s for _, s in found]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(ids.view(np.int64), mask=sizes == 0), pa.array(sizes, pa.int64())], [*kept, "set_id", "n_shingles"])

    return docs.mapInArrow(run, schema)


def _pack(found: np.ndarray, sets: np.ndarray, buckets: int):
    """A packet's shingles by bucket: sorted 48-bit ids as counts of their high 16 bits and
    their low 32 bits, with the position of each one's set in the packet. An id that ``FOLD``
    sets of the packet hold goes once, with their number; where it stands stays with the
    packet (the second result: ids, numbers, positions)."""
    order = np.argsort(found, kind="stable")
    ids, sets = found[order] >> ID_SHIFT, sets[order]
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(ids)), bool), ids[1:] != ids[:-1]]))
    counts = np.diff(np.append(start, len(ids)))
    often = counts >= FOLD
    cold = np.repeat(~often, counts)
    folded = (ids[start[often]], counts[often].astype(np.uint32), sets[~cold])
    ids, sets = ids[cold], sets[cold]
    rows = {b: [None, None, None, folded[0][a:z].tobytes() + folded[1][a:z].tobytes()] for b, a, z in bucket_runs(folded[0] << ID_SHIFT, buckets)}
    for b, a, z in bucket_runs(ids << ID_SHIFT, buckets):
        own = ids[a:z]
        highs = np.bincount((own >> LOW).astype(np.int64) - _least_high(b, buckets)).astype(np.uint32)
        rows.setdefault(b, [None, None, None, b""])[:3] = highs.tobytes(), own.astype(np.uint32).tobytes(), sets[a:z].tobytes()
    return rows, folded


def _buffers(t: pa.Table, *names: str):
    """The rows' binary values without copies, None for null."""
    return zip(*((x.as_buffer() for x in t[c]) for c in names), strict=True)


def _least_high(bucket: int, buckets: int) -> int:
    """The smallest high 16 bits of a bucket's ids."""
    return (bucket << 32) // buckets >> 16


_PACKED = "bucket long, packet long, highs binary, lows binary, at binary, folded binary"


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def smallest_linked(percent: int) -> float:
    """The smallest size of a set that can link with a different one: one shingle more or
    less must leave the similarity."""
    return -(-percent // (100 - percent)) if percent < 100 else np.inf


def _forward(text: str, n: int, percent: int, packet: int, buckets: int, positions: np.dtype):
    names, types = ["bucket", "packet", "highs", "lows", "at", "folded"], [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    most_sets, least = PACKET_SETS * max(1, packet // PACKET), smallest_linked(percent)

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        count = sets = 0

        def flush():
            nonlocal held, count, sets, k
            number = (part << 24) | k
            ids = np.concatenate([h[0] for h in held])
            sizes = np.concatenate([h[1] for h in held])
            _, keep = np.unique(ids, return_index=True)  # equal sets of the packet are one
            at = np.full(len(ids), -1, np.int64)
            at[np.sort(keep)] = np.arange(len(keep))
            row = np.repeat(at, sizes)
            found = np.concatenate([h[2] for h in held])
            kept = np.sort(keep)
            packed, folded = _pack(found[row >= 0], row[row >= 0].astype(positions), buckets)
            meta = (number % buckets, number, None, ids[kept].tobytes(), sizes[kept].astype(np.uint32).tobytes(), pickle.dumps(folded))
            held, count, sets, k = [], 0, 0, k + 1
            return _table([meta, *((b, number, *x) for b, x in packed.items())], names, types)

        for batch in batches:
            for ids, sizes, found, first in sets_of(batch.column(text), n):
                for a in range(0, len(ids), PACKET_SETS // 4):
                    z = min(a + PACKET_SETS // 4, len(ids))
                    some = sizes[a:z] >= least
                    held.append((ids[a:z][some], sizes[a:z][some], found[first[a] : first[z]][np.repeat(some, sizes[a:z])]))
                    count, sets = count + len(held[-1][2]), sets + int(some.sum())
                    if count >= packet or sets >= most_sets // 2:
                        yield flush()
        if sets:
            yield flush()

    return run


_REPLY = "packet long, ids binary, at binary, counts binary, folded binary"


def _tally(buckets: int, positions: np.dtype):
    """In a bucket: the shingles that several sets hold, back to their packets."""

    def run(key, t):
        base = _least_high(int(key[0].as_py()), buckets)
        rows, ids, weights, packets, ats = [], [], [], [], []
        for packet, (highs, lows, at, folded) in zip(t["packet"].to_pylist(), _buffers(t, "highs", "lows", "at", "folded"), strict=True):
            if highs is None and lows is not None:
                rows.append((packet, lows.to_pybytes(), at.to_pybytes(), None, folded.to_pybytes()))
                continue
            packets.append(packet)
            counts = np.frombuffer(highs or b"", np.uint32)
            high = np.repeat((np.arange(len(counts)) + base).astype(np.uint64), counts)
            cold = (high << LOW) | np.frombuffer(lows or b"", np.uint32)
            k = folded.size // 12
            ids.append(np.concatenate([cold, np.frombuffer(folded, np.uint64, k)]))
            weights.append(np.concatenate([np.ones(len(cold), np.uint32), np.frombuffer(folded, np.uint32, k, 8 * k)]))
            ats.append(np.concatenate([np.frombuffer(at or b"", positions), np.zeros(k, positions)]))
        if ids:
            of = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in ids])
            ids, weights, ats = np.concatenate(ids), np.concatenate(weights), np.concatenate(ats)
            order = np.argsort(ids, kind="stable")
            ids, weights = ids[order], weights[order]
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            each = np.repeat(np.add.reduceat(weights, starts, dtype=np.int64), np.diff(np.append(starts, len(ids))))
            shared = each > 1
            ids, folds, of, ats, each = ids[shared], weights[shared] > 1, of[order][shared], ats[order][shared], np.minimum(each[shared], 65_535).astype(np.uint16)
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(len(packets) + 1))
            for i, packet in enumerate(packets):
                own = order[cuts[i] : cuts[i + 1]]
                if len(own):
                    once, own = own[folds[own]], own[~folds[own]]
                    x = ids[own]
                    rows.append((packet, x.astype(np.uint32).tobytes() + (x >> LOW).astype(np.uint16).tobytes(), ats[own].tobytes(), each[own].tobytes(), ids[once].tobytes() + each[once].tobytes()))
        return pa.Table.from_batches([_table(rows, ["packet", "ids", "at", "counts", "folded"], [pa.int64(), *[pa.binary()] * 4])])

    return run


def levels(n: int, percent: int) -> range:
    """Powers of two that a set of size n signs for."""
    return range(n.bit_length() - 1, (100 * n // percent).bit_length())


def groups(level: int, percent: int) -> int:
    """Groups of each class of combinations; 0: all shingles are indexed alone."""
    if level < 5:
        return 0
    return max(0, min((100 - percent) * (1 << level) // 300, (percent * percent * (1 << level) // 10_000 - 1) // 3))


_choices: dict[tuple[int, int], np.ndarray] = {}


def _choose(n: int, k: int) -> np.ndarray:
    if (n, k) not in _choices:
        _choices[n, k] = np.array(list(combinations(range(n), k)), dtype=np.int64).reshape(-1, k)
    return _choices[n, k]


def signatures(ids: np.ndarray, counts: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Of a set of size n whose shared shingles are ``ids``, by ascending count and id."""
    spare = n + (-percent * n // 100)  # n - ceil(percent * n / 100)
    need = spare + 1 - (n - len(ids))
    if need <= 0:
        return np.zeros(0, np.uint64)
    out = []
    for level in levels(n, percent):
        m, salt = groups(level, percent), np.uint64(level * 0x51ED270B + 1)
        if not m:
            out.append(mix(ids[:need] * np.uint64(3) + salt))
            continue
        own = ids[: need + 3 * m]
        kind = 1 + (counts[: len(own)] > FREQUENT) + (counts[: len(own)] > VERY_FREQUENT)
        h = mix(own)
        group = np.where(kind > 1, kind * m + (h % np.uint64(m)).astype(np.int64), 0)
        order = np.argsort(group, kind="stable")
        g = group[order]
        start = np.concatenate([[True], g[1:] != g[:-1]])
        rank = np.empty(len(own), np.int64)
        rank[order] = np.arange(len(own)) - np.maximum.accumulate(np.where(start, np.arange(len(own)), 0)) + 1
        sure = np.cumsum((kind == 1) | (rank >= kind))
        end = int(np.searchsorted(sure, need)) + 1
        out.append(mix(own[:end][kind[:end] == 1] * np.uint64(3) + salt))
        order = order[order < end]
        g = group[order]
        bounds = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])).tolist() + [len(g)]
        for a, z in zip(bounds, bounds[1:], strict=False):
            k = int(kind[order[a]]) if z > a else 1
            if k > 1 and z - a >= k:
                out.append(mix(h[order[a:z]][_choose(z - a, k)].sum(axis=1, dtype=np.uint64) * np.uint64(5) + salt))
    return np.unique(np.concatenate(out))


def _assemble(percent: int, positions: np.dtype):
    """In a packet: its sets that may have links, with shared shingles and signatures."""

    def run(t: pa.Table) -> pa.Table:
        ids, ats, counts, meta, often = [], [], [], None, []
        for x, at, c, folded in _buffers(t, "ids", "at", "counts", "folded"):
            if c is None:
                meta = (np.frombuffer(x, np.uint64), np.frombuffer(at, np.uint32).astype(np.int64), *pickle.loads(folded))
                continue
            k = c.size // 2
            ids.append((np.frombuffer(x, np.uint16, k, 4 * k).astype(np.uint64) << LOW) | np.frombuffer(x, np.uint32, k))
            ats.append(np.frombuffer(at, positions))
            counts.append(np.frombuffer(c, np.uint16))
            k = folded.size // 10
            often.append((np.frombuffer(folded, np.uint64, k), np.frombuffer(folded, np.uint16, k, 8 * k)))
        if often and len(meta[2]):  # every folded shingle is shared, so all of them came back
            shingle, count = (np.concatenate([x[i] for x in often]) for i in (0, 1))
            ids.append(np.repeat(meta[2], meta[3]))
            counts.append(np.repeat(count[np.argsort(shingle)], meta[3]))
            ats.append(meta[4])
        out = []
        if ids:
            ids, ats, counts = map(np.concatenate, (ids, ats, counts))
            have = np.bincount(ats, minlength=len(meta[0]))
            live = have >= -(-percent * meta[1] // 100)
            keep = live[ats]
            ids, ats, counts = ids[keep], ats[keep], counts[keep]
            order = np.lexsort((ids, counts, ats))
            ids, ats, counts = ids[order], ats[order], counts[order].astype(np.int64)
            cuts = np.searchsorted(ats, np.arange(len(meta[0]) + 1))
            for i in np.flatnonzero(live):
                own, n = ids[cuts[i] : cuts[i + 1]], int(meta[1][i])
                found = signatures(own, counts[cuts[i] : cuts[i + 1]], n, percent)
                out.append((int(meta[0][i].view(np.int64)), n, own.view(np.int64), found.view(np.int64)))
        packet = int(t["packet"][0].as_py())
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table(
            {
                "packet": pa.array([packet] * len(out), pa.int64()),
                "set_id": pa.array(columns[0], pa.int64()),
                "n": pa.array(columns[1], pa.int64()),
                "ids": pa.array(columns[2], pa.list_(pa.int64())),
                "signs": pa.array(columns[3], pa.list_(pa.int64())),
            }
        )

    return run


def _similar(n_a: str, n_b: str, shared, percent: int):
    return 100 * shared >= percent * (F.col(n_a) + F.col(n_b) - shared)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs a, b that link."""
    left = sets.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("ids").alias("ids_a"))
    right = sets.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("ids").alias("ids_b"))
    fits = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    met = pairs.join(left, "a").join(right, "b").where(fits)
    return met.where(_similar("n_a", "n_b", F.size(F.array_intersect("ids_a", "ids_b")).cast("long"), percent)).select("a", "b")


def _overlaps(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets of a tile and shared shingles of each two of them. Shingles that
    only one set of the tile holds are not shared."""
    ns, ids = t["n"].to_numpy(), t["ids"].combine_chunks()
    first, flat = np.asarray(ids.offsets), np.asarray(ids.values)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.where(times > 1, np.cumsum(times > 1) - 1, -1)
    column, row = place[column], np.repeat(np.arange(len(ns)), np.diff(first))
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    shared = np.zeros((len(ns), len(ns)))
    for c in range(0, int((times > 1).sum()), 4096):
        lo, hi = np.searchsorted(column, [c, c + 4096])
        x = np.zeros((len(ns), min(4096, int(column[-1]) + 1 - c)), np.float32)
        x[row[lo:hi], column[lo:hi] - c] = 1
        shared += x @ x.T  # of 4096 shingles exact in single precision
    return ns, shared.astype(np.int64)


def _tile(percent: int):
    """In a tile: pairs of different components that link, thinned to a forest."""

    def run(t: pa.Table) -> pa.Table:
        sids, labels = t["set_id"].to_numpy(), t["label"].to_numpy()
        ns, shared = _overlaps(t)
        links = (100 * shared >= percent * (ns[:, None] + ns[None, :] - shared)) & (labels[:, None] < labels[None, :])
        root = {x: x for x in labels.tolist()}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for i, j in zip(*np.nonzero(links), strict=True):
            a, b = find(int(labels[i])), find(int(labels[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(sids[i]), int(sids[j])))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _degrees(percent: int):
    """In a tile: how many sets each set links with. A tile of two blocks leaves out what
    the blocks' own tiles count."""

    def run(t: pa.Table) -> pa.Table:
        sids, block = t["set_id"].to_numpy(), t["block"].to_numpy()
        ns, shared = _overlaps(t)
        links = 100 * shared >= percent * (ns[:, None] + ns[None, :] - shared)
        links &= (block[:, None] != block[None, :]) if t["i"][0].as_py() != t["j"][0].as_py() else ~np.eye(len(ns), dtype=bool)
        return pa.table({"set_id": sids, "n_links": links.sum(axis=1)})

    return run


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    found = labels.select(F.col("node").alias("set_id"), F.col("label").alias("_label"))
    return rows.join(found, "set_id", "left").withColumn("label", F.coalesce("_label", "set_id")).drop("_label")


def _index(docs: DataFrame, scratch: Scratch, n: int, percent: int, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets that may have links, their signatures that others have too, and the pairs of
    each signature's smallest set and its others."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packet, buckets = packing(size, PACKET, BUCKET_BYTES, shuffle_partitions(spark))
    positions = np.dtype(np.uint16 if packet < 2 * PACKET else np.uint32)
    packed = texts.mapInArrow(_forward("text", n, percent, packet, buckets, positions), _PACKED)
    shared = packed.groupBy("bucket").applyInArrow(_tally(buckets, positions), _REPLY)
    raw = shared.groupBy("packet").applyInArrow(_assemble(percent, positions), "packet long, set_id long, n long, ids array<long>, signs array<long>")
    raw = scratch.save(raw, "raw")
    once = raw.groupBy("set_id").agg(F.min("packet").alias("packet"))  # a set may come in several packets
    sets = scratch.save(raw.join(once, ["set_id", "packet"]).drop("packet"), "sets")
    scratch.drop("raw")

    # What is joined to rows of a hot key is written first: Spark can then split that key.
    signed = sets.select("set_id", "n", F.explode("signs").alias("sign"))
    shared_by = scratch.save(signed.groupBy("sign").agg(F.count("*").alias("held"), F.min("set_id").alias("least")).where("held > 1"), "shared")
    signed = scratch.save(signed.join(shared_by, "sign"), "signed")
    scratch.drop("shared")
    stars = scratch.save(signed.where("set_id <> least").select(F.col("least").alias("a"), F.col("set_id").alias("b")).distinct(), "stars")
    return sets, signed, stars


def link_sets(docs: DataFrame, scratch: Scratch, n: int = 5, percent: int = 80, text: str = "text", index: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Verified links ``a``, ``b`` between set ids: enough of them to connect all sets that
    links connect."""
    sets, signed, stars = index or _index(docs, scratch, n, percent, text)
    links = scratch.save(_verified(stars, sets, percent), "links-1")
    labels = components(links, scratch, "first")

    open_signs = scratch.save(_labelled(signed, labels), "labelled")
    mixed = open_signs.groupBy("sign").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("sign")
    rest = scratch.save(open_signs.join(scratch.save(mixed, "open"), "sign"), "mixed")
    scratch.drop("signed", "labelled")

    few = rest.where(F.col("held") <= SMALL)
    x, y = few.select("sign", F.col("set_id").alias("a"), F.col("label").alias("l_a"), F.col("n").alias("n_a")), few.select("sign", F.col("set_id").alias("b"), F.col("label").alias("l_b"), F.col("n").alias("n_b"))
    fits = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    pairs = x.join(y, "sign").where((F.col("a") < F.col("b")) & (F.col("l_a") != F.col("l_b")) & fits).select("a", "b").distinct()
    pairs = scratch.save(pairs.join(stars, ["a", "b"], "left_anti"), "pairs")
    more = [scratch.save(_verified(pairs, sets, percent), "links-2")]

    many = rest.where(F.col("held") > SMALL)
    if not many.isEmpty():
        hot = components(many.select(F.col("least").alias("a"), F.col("set_id").alias("b")), scratch, "hot")
        members = many.select("set_id", "label").distinct().join(hot.select(F.col("node").alias("set_id"), F.col("label").alias("hot")), "set_id")
        # Sets of the largest component of a hot group need no tile among themselves. How
        # many blocks a group takes comes from counts, so no task sees a group's sets.
        sizes = members.groupBy("hot", "label").agg(F.count("*").alias("size"))
        plan = sizes.groupBy("hot").agg(F.max(F.struct("size", "label")).alias("top"), F.sum("size").alias("total")).select(
            "hot",
            F.col("top.label").alias("main"),
            F.ceil(F.col("top.size") / TILE_BLOCK).cast("int").alias("b0"),
            F.greatest(F.ceil((F.col("total") - F.col("top.size")) / TILE_BLOCK), F.lit(1)).cast("int").alias("b1"),
        )
        side = members.join(scratch.save(plan, "plan"), "hot").withColumn("outer", (F.col("label") != F.col("main")).cast("int"))
        h = F.xxhash64("set_id")
        dealt = side.withColumn("block", F.when(F.col("outer") == 1, F.col("b0") + F.pmod(h, F.col("b1"))).otherwise(F.pmod(h, F.col("b0"))).cast("int"))
        last = F.col("b0") + F.col("b1") - 1
        against = F.when(F.col("outer") == 1, F.sequence(F.lit(0), last)).otherwise(F.sequence(F.col("b0"), last))
        tiled = dealt.withColumn("other", F.explode(against)).select("hot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "set_id", "label")
        spread = tiled.join(sets.select("set_id", "n", "ids"), "set_id")
        more.append(scratch.save(spread.groupBy("hot", "i", "j").applyInArrow(_tile(percent), "a long, b long"), "links-3"))
    for found in more:
        links = links.unionByName(found)
    return links


def link_counts(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's id and ``n_links``: how many different sets link with its own.

    All pairs of sets of a component are held against each other, in tiles of at most two
    blocks, and counted there; pairs are not written out. The work grows with the square of
    the sets of the largest component, which ``cluster`` avoids.
    """
    return cluster(docs, n, percent, key, text, all_links=True).select(key, "n_links")


def _set_links(sets: DataFrame, labels: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """How many sets each set of a component links with: all of them are in it."""
    members = labels.select(F.col("node").alias("set_id"), F.col("label").alias("hot"))
    blocks = scratch.save(members.groupBy("hot").agg(F.ceil(F.count("*") / LINK_BLOCK).cast("int").alias("blocks")), "blocks")
    dealt = members.join(blocks, "hot").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    tiled = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("hot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_id")
    spread = tiled.join(sets.select("set_id", "n", "ids"), "set_id")
    counts = spread.groupBy("hot", "i", "j").applyInArrow(_degrees(percent), "set_id long, n_links long").groupBy("set_id").agg(F.sum("n_links").alias("n_links"))
    return scratch.save(counts, "counts")


def cluster(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", all_links: bool = False, with_sets: bool = False) -> DataFrame:
    """Each document's id, ``n_shingles``, and ``component_id``: the smallest id that links
    reach; with ``all_links`` also ``n_links``, as ``link_counts`` has it;
    with ``with_sets`` also ``set_id`` and ``label``, its component's smallest set (both
    null without words), which tell rows of a repeated id apart."""
    scratch = Scratch(docs.sparkSession, "ngrams")
    index = _index(docs, scratch, n, percent, text)
    labels = scratch.save(components(link_sets(docs, scratch, n, percent, text, index), scratch, "all"), "labels")
    counts = _set_links(index[0], labels, scratch, percent) if all_links else None
    rows = scratch.save(describe(docs.select(key, text), n, text), "rows")
    scratch.drop_all_but("labels", "rows", "counts")
    found = labels.select(F.col("node").alias("set_id"), "label")
    # A set's copies add up to one row before rows of a component meet.
    sets = rows.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min(key).alias("_least"))
    sets = scratch.save(sets.join(found, "set_id", "left").withColumn("label", F.coalesce("label", "set_id")), "set-labels")
    least = scratch.save(sets.groupBy("label").agg(F.min("_least").alias("component_id")), "least")
    of_set, links = sets.join(least, "label").select("set_id", "component_id", "label"), []
    if counts is not None:
        of_set, links = of_set.join(counts, "set_id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0))), ["n_links"]
    of_set = scratch.save(of_set, "set-components")
    scratch.drop("labels", "set-labels", "least", *(["counts"] if links else []))
    linked = rows.join(of_set, "set_id").select(key, "n_shingles", "component_id", *links, *(("set_id", "label") if with_sets else ()))
    alone = rows.where("set_id IS NULL").select(key, "n_shingles", F.col(key).alias("component_id"), *(F.lit(0).cast("long").alias(c) for c in links))
    if with_sets:
        alone = alone.withColumns({c: F.lit(None).cast("long") for c in ("set_id", "label")})
    return linked.unionByName(alone)
