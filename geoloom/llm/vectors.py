"""Embedding near-duplicates by a join of packed blocks.

Equal vectors are one class with a count. Classes are packed into blocks, a row of bytes each, and written once; the blocks meet by
Spark's nested-loop join, which reads both sides from the written table and shuffles nothing. A task multiplies unit vectors in single
precision with a margin that covers its rounding; pairs within the margin are decided on the whole vectors in double precision.
A task gives at most a row per vector that it has seen: its links and the smallest vector that they reach there.

Vectors spread over the sphere of 64 dimensions leave no grid or subspace that parts them at 0.95, so every pair is multiplied: the
time grows with the square of the different vectors, disk and shuffle with their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import connected_components, release, stage

#: Bytes of a block's vectors at most; blocks a file; pairs of blocks that pass to Python at a time.
BLOCK_BYTES, BLOCKS_A_FILE, PAIRS_A_BATCH = 1 << 19, 16, 8
#: Rows of a block that are multiplied at a time; edges that a task keeps before it joins them.
STRIP, EDGES = 512, 1 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of i and j; a label is the least index of its class."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(label, label[label]):
            label = label[label]


def _scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, the largest component from 1/2 to 1: cosines stay as they are, and no square overflows."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _units(v: np.ndarray) -> np.ndarray:
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def links_between(v: np.ndarray, w: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked rows (i of ``v``, j of ``w``) by cosine in double precision; each pair once if both are the ``same`` block."""
    p, q = _units(v), _units(w)
    size, other = np.linalg.norm(v, axis=1), np.linalg.norm(w, axis=1)
    margin = (v.shape[1] + 8) * 2.0**-22
    for s in range(0, len(v), STRIP):
        near = p[s : s + STRIP] @ q.T
        at = np.flatnonzero(near >= np.float32(threshold - margin))
        sure = near.ravel()[at] >= np.float32(threshold + margin)
        i, j = s + at // len(w), at % len(w)
        if same:
            later = i < j
            i, j, sure = i[later], j[later], sure[later]
        check = np.flatnonzero(~sure)
        for c in range(0, len(check), 20_000):
            k = check[c : c + 20_000]
            a, b = i[k], j[k]
            sure[k] = np.einsum("ij,ij->i", v[a], w[b]) >= threshold * size[a] * other[b]
        if sure.any():
            yield i[sure], j[sure]


def near_vectors(emb: DataFrame, threshold: float = 0.95, tile: int = 2048) -> DataFrame:
    """Links of cosine at least ``threshold`` in double precision among all vectors, and their components.

    emb: vec_id long, embedding array; other columns are ignored. Vectors that are null, empty, zero, or hold a null or
    non-finite component link with nothing, as do rows without a vec_id; vectors link only with those of their length.
    Returns one row per row: vec_id, n_links (other vectors linked directly; copies count each), component_id (the
    smallest vec_id reachable), kept (vec_id = component_id).

    Equal vectors are one class with a count, so copies are never paired. ``tile`` is the most vectors of a block.
    """
    ok = (
        F.col("vec_id").isNotNull() & (F.size("v") > 0)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    single = emb.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = emb.select("vec_id", F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(F.coalesce(ok, F.lit(False)), F.col("v")))
    classes = stage(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    kind = np.float32 if single else np.float64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}

        def row(d: int, some: list[tuple]) -> pa.RecordBatch:
            ids, n, v = zip(*some)
            whole = [np.array(ids, np.int64).tobytes(), np.array(n, np.int64).tobytes(), np.stack(v).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *(pa.array([x], pa.binary()) for x in whole)], ["dims", "ids", "ns", "v"])

        for batch in batches:
            vectors = batch.column(2)
            flat, at = vectors.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(vectors.value_lengths().to_numpy())]
            for k, (id_, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                d = int(at[k + 1] - at[k])
                some = waiting.setdefault(d, [])
                some.append((id_, n, flat[at[k] : at[k + 1]].astype(kind)))
                if len(some) >= min(tile, max(1, BLOCK_BYTES // (d * kind().itemsize))):
                    yield row(d, waiting.pop(d))
        for d, some in waiting.items():
            yield row(d, some)

    blocks = classes.select("id", "n", "v").mapInArrow(pack, "dims int, ids binary, ns binary, v binary")
    packed = stage(blocks.select(F.monotonically_increasing_id().alias("block"), "*"), BLOCKS_A_FILE)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts: dict[int, int] = {}
        ids, links, label, edges, held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def joined() -> np.ndarray:
            return _unite(label, *(np.concatenate(e) for e in zip(*edges))) if edges else label

        for batch in batches:
            for r in batch.to_pylist():
                sides = []
                for x in "ab":
                    own, n = np.frombuffer(r[f"{x}ids"], np.int64), np.frombuffer(r[f"{x}ns"], np.int64)
                    if r[f"{x}block"] not in starts:
                        starts[r[f"{x}block"]] = len(ids)
                        label = np.r_[label, np.arange(len(ids), len(ids) + len(own))]
                        ids, links = np.r_[ids, own], np.r_[links, np.zeros(len(own), np.int64)]
                    sides.append((starts[r[f"{x}block"]], n, _scaled(np.frombuffer(r[f"{x}v"], kind).reshape(len(own), -1).astype(np.float64))))
                (p, n, v), (q, m, w) = sides
                both = np.arange(len(n) + len(m))
                for i, j in links_between(v, w, p == q, threshold):
                    links[p : p + len(n)] += np.bincount(i, m[j], len(n)).astype(np.int64)
                    links[q : q + len(m)] += np.bincount(j, n[i], len(m)).astype(np.int64)
                    both = _unite(both, i, j + len(n))
                moved = np.flatnonzero(both != np.arange(len(both)))
                place = np.r_[p + np.arange(len(n)), q + np.arange(len(m))]
                if len(moved):
                    edges.append((place[moved], place[both[moved]]))
                    held += len(moved)
                if held > EDGES:
                    label, edges, held = joined(), [], 0
        label = joined()
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        hit = np.flatnonzero(links)
        for lo in range(0, len(hit), 10_000):
            k = hit[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(links[k]), pa.array(least[label[k]])], ["id", "links", "root"])

    a, b = (packed.select(*[F.col(k).alias(f"{x}{k}") for k in packed.columns]) for x in "ab")
    # Of two blocks either may be the left one, so that every task has about half of its pairs. Lengths are told apart by their difference,
    # as an equality would send all vectors of one length to one task.
    turn = (F.col("ablock") + F.shiftright("ablock", 33) + F.col("bblock") + F.shiftright("bblock", 33)) % 2 == 0
    once = (F.col("ablock") == F.col("bblock")) | (turn == (F.col("ablock") < F.col("bblock")))
    pairs = a.hint("shuffle_replicate_nl").join(b, (F.abs(F.col("adims") - F.col("bdims")) < 1) & F.coalesce(once, F.lit(False)))
    spark = emb.sparkSession
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(PAIRS_A_BATCH))
    try:
        found = stage(pairs.mapInArrow(link, "id long, links long, root long"))
    finally:
        spark.conf.set(_BATCH, before)
    release(packed)
    component = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    each = stage(
        classes.join(links, "id", "left")
        .join(component, "id", "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    )
    release(classes)
    linked = rows.where("v IS NOT NULL").join(each, "v", "left").select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
