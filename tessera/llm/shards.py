"""Training-order materialisation of token ids in binary shards.

Texts become token ids and then sequences of a fixed length. A keyed Feistel permutation
over the next power of four, walked along its cycles until it falls among the sequences,
gives each sequence a slot of its own in a global order that only the key and the number
of sequences decide. Range partitions of slots are the shards: a sequence of any slot
stands in shard ``slot // rows`` at byte ``slot % rows * stride``, so a reader can start
at any slot and go on from there without an index.

``materialise`` writes all shards, a partition a run of whole shards, and returns a row a
sequence that tells of what stands in the file. It does so in a few waves, each of half the
shards that are left and with a shuffle of its own that is freed before the next: the more
shards stand on the disk, the less is shuffled beside them. Sequences travel without their padding, which is added where
they are written.

Cases: a null or empty text makes no sequence; the last sequence of a text is filled with
the padding id; a text of any length is cut into as many sequences as it takes; rows that
repeat make sequences of their own; without sequences there are no shards; other columns,
whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
import math
import posixpath
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytebpe import load_ranks
from tessera.plans.runtime import Scratch, ship, shuffle_partitions

ROUNDS = 4
#: Sequence length in ids; ids are little-endian unsigned 16-bit integers.
LENGTH = 512
#: Sequences of a shard.
SHARD_ROWS = 8192
#: Ids that texts' tokens don't use.
PADDING = 65_535
#: Shards that one task writes, at most; runs of shards that are shuffled one after another.
TASK_SHARDS, WAVES = 32, 5
_SLICE = 64


def feistel(x: np.ndarray, key: int, bits: int) -> np.ndarray:
    """A permutation of the numbers below ``4 ** bits``: rounds over halves of ``bits`` bits."""
    low = np.uint64((1 << bits) - 1)
    left, right = x.astype(np.uint64) >> np.uint64(bits), x.astype(np.uint64) & low
    for r in range(ROUNDS):
        h = right ^ np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xBF58476D1CE4E5B9) % (1 << 64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        left, right = right, left ^ ((h ^ (h >> np.uint64(31))) & low)
    return (left << np.uint64(bits)) | right


def half_bits(n: int) -> int:
    return max(1, math.ceil(max(1, n - 1).bit_length() / 2))


def slots(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of sequences ``index`` among n: a permutation of 0 .. n - 1."""
    bits, out = half_bits(n), index.astype(np.uint64)
    out = feistel(out, key, bits)
    while (outside := out >= np.uint64(n)).any():
        out[outside] = feistel(out[outside], key, bits)
    return out.astype(np.int64)


def token_sequences(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's sequences: the key, ``part`` (from 0), ``n_tokens`` without padding,
    ``tokens`` (binary), and ``task`` and ``row``, which number them all."""
    ship(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))  # a vocabulary's fixed size
    schema = docs.select(key).schema.add("part", "integer").add("n_tokens", "integer").add("tokens", "binary").add("task", "integer").add("row", "long")

    def run(batches):
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a in range(0, len(batch), _SLICE):
                some = batch.slice(a, _SLICE)
                at, parts, sizes, tokens = [], [], [], []
                for i, t in enumerate(some.column(text).to_pylist()):
                    ids = np.array(encoding.encode_ordinary(t), dtype="<u2") if t else np.zeros(0, "<u2")
                    for k in range(0, len(ids), length):
                        own = ids[k : k + length]
                        at.append(i)
                        parts.append(k // length)
                        sizes.append(len(own))
                        tokens.append(own.tobytes())
                rows = np.arange(done, done + len(at))
                done += len(at)
                yield pa.RecordBatch.from_arrays(
                    [some.column(key).take(pa.array(at, pa.int64())), pa.array(parts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(tokens, pa.binary()), pa.array([task] * len(at), pa.int32()), pa.array(rows, pa.int64())],
                    schema.names,
                )

    return docs.select(key, text).mapInArrow(run, schema)


def assign_slots(sequences: DataFrame, seed: int, shard_rows: int, length: int) -> tuple[DataFrame, int]:
    """Add ``slot``, ``shard`` and ``offset`` (the byte in the shard); and how many there are.

    A sequence's number is its row in its task after the rows of the tasks before. Only the
    tasks' counts come to the driver, a number for each input partition.
    """
    spark = sequences.sparkSession
    counts = {r["task"]: r["n"] for r in sequences.groupBy("task").agg(F.count("*").alias("n")).collect()}
    starts, n = {}, 0
    for task in sorted(counts):
        starts[task], n = n, n + counts[task]
    sent = spark.sparkContext.broadcast(starts)

    @F.pandas_udf("long")
    def slot(task, row):
        start = task.map(sent.value).to_numpy(dtype=np.int64)
        import pandas as pd

        return pd.Series(slots(start + row.to_numpy(dtype=np.int64), n, seed))

    # Called so, filters on the slot don't compute it once more.
    placed = sequences.withColumn("slot", slot.asNondeterministic()("task", "row")).drop("task", "row")
    stride = 2 * length
    place: dict[str, Column] = {"shard": F.floor(F.col("slot") / shard_rows).cast("int"), "offset": F.col("slot") % shard_rows * stride}
    return placed.withColumns(place), n


def _in_ranges(placed: DataFrame, first: int, count: int) -> DataFrame:
    """Partitions that are ranges of slots, each of whole shards of ``count``, in order."""
    run = min(TASK_SHARDS, max(1, count // (4 * shuffle_partitions(placed.sparkSession))))
    return placed.repartitionById(max(1, -(-count // run)), F.floor((F.col("shard") - first) / run).cast("int")).sortWithinPartitions("slot")


def in_training_order(docs: DataFrame, path: str, pattern: str, seed: int = 20_240_131, length: int = LENGTH, shard_rows: int = SHARD_ROWS, key: str = "doc_id") -> DataFrame:
    """All sequences, ``tokens`` with their padding, in range partitions of slots."""
    scratch = Scratch(docs.sparkSession, "order")
    sequences = scratch.save(token_sequences(docs, path, pattern, length, key), "sequences")
    placed, n = assign_slots(sequences, seed, shard_rows, length)
    return _in_ranges(placed, 0, -(-n // shard_rows)).withColumn("tokens", F.rpad("tokens", 2 * length, F.lit(b"\xff")))


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _written(ordered: DataFrame, folder: str, length: int) -> DataFrame:
    """Write the shards of partitions that hold whole shards in order, under another name
    until whole, and read each back: its rows, with the digests of the bytes that stand in
    the file, the file and its size."""
    stride = 2 * length
    names = [c for c in ordered.columns if c != "tokens"]
    schema = ordered.select(*names).schema.add("tokens_sha256", "binary").add("shard_file", "string").add("shard_bytes", "long")

    def read_back(store, base, own, number, rows):
        name = posixpath.join(base, f"shard-{number:08d}.bin")
        store.move(own, name)
        with store.open_input_file(name) as f:
            raw = f.read()
        rows = pa.Table.from_batches(rows).combine_chunks()
        if len(raw) != stride * len(rows):
            raise ValueError(f"{name} has {len(raw)} bytes for {len(rows)} sequences")
        digests = [hashlib.sha256(raw[at : at + stride]).digest() for at in rows["offset"].to_pylist()]
        file = posixpath.join(folder, posixpath.basename(name))
        full = rows.append_column("tokens_sha256", pa.array(digests, pa.binary())).append_column("shard_file", pa.array([file] * len(rows), pa.string())).append_column("shard_bytes", pa.array([len(raw)] * len(rows), pa.int64()))
        return full.to_batches()

    def run(batches):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        number, f, own, rows, done = None, None, "", [], 0
        for batch in batches:
            shard, tokens = batch.column("shard").to_numpy(), batch.column("tokens")
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)] if len(shard) else []
            for a, z in zip(cuts, cuts[1:], strict=False):
                if shard[a] != number:
                    if f is not None:
                        f.close()
                        yield from read_back(store, base, own, number, rows)
                    number, own, rows, done = int(shard[a]), posixpath.join(base, f".{uuid.uuid4().hex}"), [], 0
                    f = store.open_output_stream(own)
                some = batch.slice(a, z - a)
                if some.column("offset").to_pylist() != list(range(done, done + stride * (z - a), stride)):
                    raise ValueError(f"shard {number} has gaps or is out of order")
                f.write(b"".join(x.as_py().ljust(stride, b"\xff") for x in tokens.slice(a, z - a)))
                done += stride * (z - a)
                rows.append(some.select(names))
        if f is not None:
            f.close()
            yield from read_back(store, base, own, number, rows)

    return ordered.select(*names, "tokens").mapInArrow(run, schema)


def materialise(docs: DataFrame, path: str, pattern: str, seed: int = 20_240_131, length: int = LENGTH, shard_rows: int = SHARD_ROWS, key: str = "doc_id") -> DataFrame:
    """Write all shards to the shared folder; each sequence's key, ``part``, ``n_tokens``,
    ``slot``, ``shard`` and ``offset``, ``tokens_sha256`` of its bytes as read back from the
    file, ``shard_file`` and ``shard_bytes``.

    A partition is a range of slots of whole shards, so a shard is written where it lands.
    """
    scratch = Scratch(docs.sparkSession, "order")
    sequences = scratch.save(token_sequences(docs, path, pattern, length, key), "sequences", "zstd")
    placed, n = assign_slots(sequences, seed, shard_rows, length)
    count, first, found = -(-n // shard_rows), 0, []
    while first < count or not found:
        wave = count - first if len(found) == WAVES - 1 else -(-(count - first) // 2)
        own = placed.where((F.col("shard") >= first) & (F.col("shard") < first + wave))
        found.append(scratch.save(_written(_in_ranges(own, first, wave), f"{scratch.base}/shards", length), f"rows-{first}"))
        first += wave
        del own
        scratch.free_shuffles(now=True)  # nothing refers to this wave's any more
    scratch.drop("sequences")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumn("tokens_sha256", F.lower(F.hex("tokens_sha256")))


def write_shards(ordered: DataFrame, folder: str, length: int = LENGTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write ``shard-<number>.bin`` to a folder that all executors reach (a path or a URI).

    A shard is written under another name and renamed when whole, so a task that is run
    again replaces its shards. Returns shard, n_sequences and bytes.
    """

    def run(key, t):
        from pyarrow import fs

        number = key[0].as_py()
        t = t.sort_by("slot")
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        name, own = posixpath.join(base, f"shard-{number:08d}.bin"), posixpath.join(base, f".{uuid.uuid4().hex}")
        done = 0
        with store.open_output_stream(own) as f:
            for tokens in t["tokens"]:
                done += f.write(tokens.as_buffer()) or 2 * length
        store.move(own, name)
        return pa.table({"shard": pa.array([number], pa.int32()), "n_sequences": pa.array([len(t)], pa.int64()), "bytes": pa.array([done], pa.int64())})

    return ordered.select("shard", "slot", "tokens").groupBy("shard").applyInArrow(run, "shard int, n_sequences long, bytes long")


def read_from(folder: str, slot: int, length: int = LENGTH, shard_rows: int = SHARD_ROWS):
    """Yield (slot, ids without padding) from a slot on, shard after shard."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    shard, stride = slot // shard_rows, 2 * length
    while store.get_file_info(name := posixpath.join(base, f"shard-{shard:08d}.bin")).type == fs.FileType.File:
        with store.open_input_file(name) as f:
            f.seek((slot - shard * shard_rows) * stride)
            while raw := f.read(stride):
                ids = np.frombuffer(raw, "<u2")
                yield slot, ids[ids != PADDING]
                slot += 1
        shard += 1
        slot = max(slot, shard * shard_rows)
