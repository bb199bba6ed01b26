"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A document descends three levels. At each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the key
and the child's name, and the smallest draw wins. A child's draw depends on nothing but the key, its name and its own
weight, so a change of one weight moves rows only into or out of the subtrees whose weights changed.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(n: int, racks: int = 3, per_rack: int = 4, base: int = 24) -> list[Leaf]:
    """The tree of ``n`` shards: regions of ``racks * per_rack`` up to ``base`` shards; each later shard opens a region.

    As a later shard is alone in its region, no weight of another subtree changes, and it takes rows only into itself.
    """
    size = racks * per_rack
    return [
        Leaf(f"r{s // size}", f"r{s // size}k{s % size // per_rack}", s) if s < base else Leaf(f"x{s}", f"x{s}k0", s)
        for s in range(n)
    ]


def _draw(level: str, child: object, weight: float, key: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(level), F.lit(child), key), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(u) / F.lit(float(weight))


def _winner(level: str, children: dict, key: Column) -> Column:
    """children: name to weight. The name with the smallest draw, ties to the smaller name."""
    live = {c: w for c, w in children.items() if w > 0}
    if len(live) == 1:
        return F.lit(next(iter(live)))
    return F.array_min(F.array(*[F.struct(_draw(level, c, w, key).alias("d"), F.lit(c).alias("c")) for c, w in live.items()]))["c"]


def place(tree: Sequence[Leaf], key: Column) -> Column:
    """The shard (int) of ``key`` in ``tree``. Children of weight 0 get nothing; a null key is a key like any other."""
    regions: dict[str, float] = {}
    racks: dict[str, dict[str, float]] = {}
    shards: dict[str, dict[int, float]] = {}
    for leaf in tree:
        regions[leaf.region] = regions.get(leaf.region, 0) + leaf.weight
        inside = racks.setdefault(leaf.region, {})
        inside[leaf.rack] = inside.get(leaf.rack, 0) + leaf.weight
        shards.setdefault(leaf.rack, {})[leaf.shard] = leaf.weight

    def descend(level: str, names: dict, below) -> Column:
        names = {n: w for n, w in names.items() if w > 0}
        if len(names) == 1:
            return below(next(iter(names)))
        won, out = _winner(level, names, key), None
        for n in names:
            out = F.when(won == n, below(n)) if out is None else out.when(won == n, below(n))
        return out

    return descend("region", regions, lambda r: descend("rack", racks[r], lambda k: _winner("shard", shards[k], key))).cast("int")


def shard(docs: DataFrame, n_shards: int = 24, rows_per_bucket: int = 20_000) -> DataFrame:
    """Every row's shard, and its slot there, under the law ``key``.

    docs: doc_id long, text string; other columns are ignored. Returns doc_id, size (UTF-8 bytes of the text plus 8; a
    null text has none), text_crc32 (of the UTF-8 bytes; a null text counts as empty), law, shard, slot (gapless from 0
    in each shard), grown_shard (the shard among ``n_shards + 1``).

    Slots come from small hash buckets inside each shard: buckets are counted with map-side sums, a running sum over
    the counts gives each bucket's first slot, and rows are numbered inside their bucket. No task holds a whole shard,
    and the text itself is never shuffled. Rows that are equal in doc_id and text share a bucket and differ in slot.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("none"))
    grown = place(topology(n_shards + 1), F.col("doc_id"))
    own = place(topology(n_shards), F.col("doc_id"))
    buckets = max(8, docs.count() // (n_shards * rows_per_bucket))
    bucket = F.pmod(F.xxhash64(F.lit("bucket"), "doc_id"), F.lit(buckets)).alias("bucket")
    counts = rows.select(own.alias("shard"), bucket).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    first = counts.select(
        "shard", "bucket",
        (F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("first"),
    )
    placed = rows.select(
        "doc_id", (F.octet_length("text") + F.lit(8)).cast("long").alias("size"), F.crc32("text").alias("text_crc32"),
        own.alias("shard"), grown.alias("grown_shard"), bucket,
    )
    inside = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return (
        placed.withColumn("nth", inside)
        .join(first, ["shard", "bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard",
        )
    )
