"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A tree has regions, racks and shards. A row descends it level by level: each child draws
``ln(u) / weight`` with ``u`` a hash of the row's key and the child's name, and the highest
draw wins. A child's share is its weight's share. A weight that changes moves rows only
into or out of the subtrees whose weights change: the other children's draws stay as they
were. Shards beyond those that a store was built with are regions of their own, so each of
them takes rows only into itself, and how many shards there are decides alone where a key
is, whether a store was made with them or grew to them.

Cases: a null or empty text has size 8 and checksum 0, a long one counts with all its bytes;
a null key is a key of its own; rows that repeat go to one shard, in slots of their own; an
empty table stays empty; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.plans.runtime import Scratch

#: Hash bits of a draw.
DRAW_BITS = 52
#: Rows numbered in one task by about this many.
ROWS_A_PART = 50_000


@dataclass(frozen=True)
class Node:
    """A shard (with its number) or an inner node; an inner node weighs what is below it."""

    name: str
    own_weight: float = 1.0
    shard: int | None = None
    children: tuple[Node, ...] = ()

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


#: Shards that a store is built with: those after them are regions of their own.
BUILT = 24


def tree(shards: int, shards_a_rack: int = 4, racks_a_region: int = 2, weights: dict[int, float] | None = None, built: int = BUILT) -> Node:
    """The first ``built`` shards dealt to racks and racks to regions in order of their
    numbers, where the last rack and region may be part full; then one region a shard.
    Names don't depend on how many shards there are."""
    weights = weights or {}
    leaves = [Node(f"shard{i}", weights.get(i, 1.0), i) for i in range(min(shards, built))]
    racks = [Node(f"rack{i // shards_a_rack}", children=tuple(leaves[i : i + shards_a_rack])) for i in range(0, len(leaves), shards_a_rack)]
    regions = [Node(f"region{i // racks_a_region}", children=tuple(racks[i : i + racks_a_region])) for i in range(0, len(racks), racks_a_region)]
    root = Node("root", children=tuple(regions))
    for i in range(built, shards):
        root = grown(root, i, weights.get(i, 1.0))
    return root


def grown(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a rack and region of its own."""
    leaf = Node(f"shard{shard}", weight, shard)
    return Node(root.name, children=(*root.children, Node(f"region-of-{leaf.name}", children=(Node(f"rack-of-{leaf.name}", children=(leaf,)),))))


def _draw(key: Column, child: Node) -> Column:
    """The child's draw: the natural logarithm of a uniform number over its weight."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(child.name)), 64 - DRAW_BITS)
    return F.log((bits.cast("double") + 0.5) / F.lit(float(1 << DRAW_BITS))) / F.lit(float(child.weight))


def _descend(key: Column, node: Node) -> Column:
    """The shard that the key comes to; equal draws go to the child that stands first."""
    open_children = [c for c in node.children if c.weight > 0]
    if node.shard is not None:
        return F.lit(node.shard)
    if len(open_children) == 1:
        return _descend(key, open_children[0])
    draws = [_draw(key, c) for c in open_children]
    best = F.greatest(*draws)
    found = _descend(key, open_children[-1])
    for child, draw in reversed(list(zip(open_children[:-1], draws[:-1], strict=True))):
        found = F.when(draw == best, _descend(key, child)).otherwise(found)
    return found


def place(df: DataFrame, root: Node, key: str, out: str = "shard") -> DataFrame:
    """Add the shard of each row's key."""
    return df.withColumn(out, _descend(F.coalesce(F.col(key).cast("string"), F.lit("\0null")), root).cast("int"))


def number(df: DataFrame, by: str, order: list[str], scratch: Scratch, out: str = "slot") -> DataFrame:
    """Number the rows of each ``by`` from 0 without gaps, no task numbering a whole shard.

    Rows fall into parts by a hash of the ordering columns and of a number that is written
    with the row, so that copies of one row are dealt out too; a part's first number is the
    count of the rows in the parts before it, its rows are ordered by those columns.
    """
    order = [*order, "_copy"]
    df = scratch.save(df.withColumn("_copy", F.monotonically_increasing_id()), "rows")
    parts = max(1, df.count() // ROWS_A_PART)
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy(by, "_part").count()
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(by).alias("_by"), F.col("_part").alias("_of"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(by, "_part").orderBy(*order)
    numbered = dealt.withColumn("_row", F.row_number().over(within) - 1)
    joined = numbered.join(starts, (F.col(by) == F.col("_by")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn(out, (F.col("_start") + F.col("_row")).cast("long")).drop("_part", "_row", "_by", "_of", "_start", "_copy")


def shard_documents(df: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with size, checksum, shard, slot in the shard, and the shard with one more."""
    root, body = tree(shards), F.coalesce(F.col(text), F.lit(""))
    described = df.select(
        F.col(key),
        (F.octet_length(body) + 8).cast(T.LongType()).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = place(place(described, root, key), grown(root, shards), key, "grown_shard")
    return number(placed, "shard", [key, "text_crc32"], Scratch(df.sparkSession, "shards"))
