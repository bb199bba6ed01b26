"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Each tree of the forest is a trie of signatures, cut at the prefix that texts must share, which is shortened from the
tree's depth until the trees together reach the target recall. All texts under one prefix are a bucket, and every pair
of a bucket whose sizes allow the similarity and whose whole signatures agree enough is a link of a candidate component;
inside a component every pair of texts is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import connected_components, parts, stage
from geoloom.llm.textwords import mix, shingles
from geoloom.llm.vectors import _unite

TREES, DEPTH = 16, 6


def prefix_length(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix with which ``trees`` trees meet pairs of similarity ``threshold`` with probability ``recall``."""
    k = depth
    while k > 1 and 1 - (1 - threshold**k) ** trees < recall:
        k -= 1
    return k


def signature(found: np.ndarray) -> bytes:
    """TREES * DEPTH minima of shingle hashes as big-endian 32-bit numbers, so that bytes sort as numbers."""
    out = np.empty(TREES * DEPTH, ">u4")
    for lo in range(0, len(out), 8):  # few functions at once bound the memory of very long texts
        salt = mix(np.arange(lo + 1, lo + 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out[lo : lo + 8] = (mix(found[None, :] ^ salt[:, None]).min(axis=1) >> np.uint64(32)).astype(np.uint32)
    return out.tobytes()


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many places of each row of ``a`` and each row of ``b`` are equal."""
    if len(a) * len(b) <= 256:
        return (a[:, None] == b[None]).sum(2)
    out = np.zeros((len(a), len(b)), np.uint8)
    at, bt = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    same = np.empty(out.shape, bool)
    for x, y in zip(at, bt):
        np.equal(x[:, None], y[None], out=same)
        np.add(out, same.view(np.uint8), out=out)
    return out


def _candidates(table: pa.Table, bounds: np.ndarray, threshold: float) -> pa.RecordBatch:
    """Links that join what may be alike among rows of each stretch between ``bounds``: at most a row per text.

    Only the last byte of each minimum is compared, so at least as many places agree as in the whole signatures.
    """
    ids, size = table.column("id").to_numpy(), table.column("size").to_numpy()
    low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(len(ids), -1)
    least, a, b = 0.7 * threshold * TREES * DEPTH, [], []
    for lo, hi in zip(bounds, [*bounds[1:], len(ids)]):
        if hi - lo < 2:
            continue
        order = np.argsort(size[lo:hi], kind="stable") + lo
        s, g, block = size[order], low[order], 256
        ii, jj = [], []
        for k in range(0, len(order), block):
            # Sorted by size, only the stretch of sizes near enough is compared.
            end = int(np.searchsorted(s, s[min(k + block, len(s)) - 1] / threshold + 1e-9, "right"))
            i, j = np.nonzero(_agree(g[k : k + block], g[k:end]) >= least)
            i, j = i + k, j + k
            near = (i < j) & (s[i] >= threshold * s[j] - 1e-9)
            ii.append(i[near])
            jj.append(j[near])
        i, j = np.concatenate(ii), np.concatenate(jj)
        if len(i):
            label = _unite(np.arange(len(order)), i, j)
            hit = np.flatnonzero(label != np.arange(len(order)))
            a.append(ids[order[hit]])
            b.append(ids[order[label[hit]]])
    none = [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or none)) for x in (a, b)], ["a", "b"])


def _verify(table: pa.Table, n: int, threshold: float) -> pa.Table:
    """Links within one tile: per text the copies linked to it, and the least id of its links' component."""
    # Repeated rows of one document bring its text more than once; its copies are in the count.
    table = table.take(pa.array(np.unique(table.column("id").to_numpy(), return_index=True)[1]))
    ids, copies = table.column("id").to_numpy(), table.column("n").to_numpy()
    guest = table.column("guest").to_numpy(zero_copy_only=False)
    sets = [shingles(t, n) for t in table.column("text").to_pylist()]
    size = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, int)
    owner = np.repeat(np.arange(len(sets)), size)
    often = np.bincount(code) if len(code) else code
    shared = often[code] > 1
    code, owner = np.unique(code[shared], return_inverse=True)[1], owner[shared]
    left, right = np.flatnonzero(~guest), np.flatnonzero(guest)
    within = not len(right)
    if within:
        right = left
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    by = np.argsort(code, kind="stable")
    code, owner = code[by], owner[by]
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [lo, lo + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[a:b], code[a:b] - lo] = 1
        both += has @ has.T
    common = both[np.ix_(left, right)].astype(np.float64)
    linked = (common >= threshold * (size[left][:, None] + size[right][None, :] - common) - 1e-9) & (common > 0)
    i, j = np.nonzero(linked)
    i, j = left[i], right[j]
    if within:
        i, j = i[i < j], j[i < j]
    links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
    label = _unite(np.arange(len(ids)), i, j)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    hit = links > 0
    return pa.table({"id": ids[hit], "links": links[hit].astype(np.int64), "root": least[label][hit]})


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, tile: int = 128, tile_sigs: int = 1024) -> DataFrame:
    """Links between texts whose sets of ``n``-word runs have a Jaccard similarity of at least ``threshold``.

    docs: doc_id long, text; other columns are ignored. A text of fewer than n words has the one run of all its words;
    null, empty and blank texts, and rows without a doc_id, link with nothing. Returns one row per row: doc_id, n_links
    (other documents linked directly), component_id (the smallest doc_id reachable), kept (doc_id = component_id).

    Texts with equal sets are one class with a count. A crowded bucket is split by size and then into parts of about
    ``tile_sigs`` signatures, every pair of parts met; large components are verified in tiles of ``tile`` texts, every
    pair of tiles a group of its own. A group gives at most a row per text. Every verified link is exact. A pair is
    missed only if no tree has it in one bucket, which is rarer than 1 - ``recall`` whatever other texts there are, or if
    fewer than 0.7 * ``threshold`` of its signature agrees, about six standard deviations below 0.8.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, sig, size = [], [], []
            for t in batch.column(1):
                found = shingles(t.as_py(), n)
                some = len(found) > 0
                # Two independent sums over a set's members name the set.
                key.append((mix(found).sum(dtype=np.uint64).tobytes() + mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).tobytes()) if some else None)
                sig.append(signature(found) if some else None)
                size.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(key, pa.binary()), pa.array(sig, pa.binary()), pa.array(size, pa.int64())],
                ["doc_id", "th", "set_key", "sig", "size"],
            )

    signed = stage(rows.mapInArrow(sign, "doc_id long, th long, set_key binary, sig binary, size long"))
    classes = stage(
        signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "th")).alias("first"), F.count("*").alias("n"), F.any_value("sig").alias("sig"), F.any_value("size").alias("size"))
        .select("set_key", F.col("first.doc_id").alias("id"), F.col("first.th").alias("id_th"), "n", "sig", "size")
    )

    need = 4 * prefix_length(threshold, recall)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, TREES * need // 4 + 1, dtype=np.uint64)).reshape(TREES, -1)
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(batch.num_rows, TREES, DEPTH)
            # A sum of mixed values names the prefix; prefixes that meet by chance only make a bucket larger.
            name = mix(sig[:, :, : need // 4].astype(np.uint64) ^ salt).sum(axis=2, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(name.ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), TREES)))], ["bucket", "cls"])

    def brief(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, 4)[:, 3].tobytes()
            width = TREES * DEPTH
            cut = pa.array([low[k : k + width] for k in range(0, len(low), width)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("cls", "id", "size")), cut], ["cls", "id", "size", "low"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by tile; one of at most two parts of ``tile_sigs`` texts is held at once.
        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now])
            keys = now.column("tile").combine_chunks()
            ends = np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1
            done = int(ends[-1]) if len(ends) else 0
            if done:
                yield _candidates(now.slice(0, done), np.r_[0, ends], threshold)
            rest = now.slice(done)
        if rest is not None and len(rest):
            yield _candidates(rest, np.array([0, len(rest)]), threshold)

    named = classes.select(F.xxhash64("set_key").alias("cls"), "sig", "id", "size")
    forest = stage(named.select("cls", "sig").mapInArrow(plant, "bucket long, cls long"))
    full = stage(forest.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"))
    sigs = stage(named.mapInArrow(brief, "cls long, id long, size long, low binary"))
    planted = stage(forest.join(full, "bucket").join(sigs, "cls").select("bucket", "m", "id", "size", "low"))
    # Sets so like are at most one class of sizes apart: a crowded bucket is split into all pairs of neighbouring classes.
    size_class = F.floor(F.log(F.col("size").cast("double")) / float(-np.log(min(threshold, 0.99))) + 1e-9)
    split = planted.where(F.col("m") > tile_sigs).withColumn("sizes", F.explode(F.array(size_class, size_class + 1)))
    counted = stage(split.groupBy("bucket", "sizes").agg(F.ceil(F.count("*") / tile_sigs).cast("int").alias("tiles")))
    part = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    crowded = (
        split.join(counted, ["bucket", "sizes"])
        .withColumn("own", part)
        .select("bucket", "sizes", "own", "id", "size", "low", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
        .select(F.concat_ws("/", "bucket", "sizes", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "id", "size", "low")
    )
    plain = planted.where(F.col("m") <= tile_sigs).select(F.col("bucket").cast("string").alias("tile"), "id", "size", "low")
    likely = (
        plain.union(crowded)
        .repartition(parts(docs.sparkSession), "tile")
        .sortWithinPartitions("tile")
        .mapInArrow(alike, "a long, b long")
        .distinct()
    )
    members = stage(connected_components(likely).join(classes.select("id", "id_th", "n"), "id"))
    crowded = (
        members.groupBy("component").agg(F.count("*").alias("m")).where(F.col("m") > tile)
        .select("component", F.ceil(F.col("m") / tile).cast("int").alias("tiles"))
    )
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    dealt = (
        members.join(stage(crowded), "component", "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("own", own)
        .select("id", "id_th", "n", "component", "own", F.sequence(F.lit(0), F.col("tiles") - 1).alias("others"))
    )
    texts = rows.where("doc_id IS NOT NULL").join(dealt, (rows["doc_id"] == dealt["id"]) & (rows["th"] == dealt["id_th"])).select("id", "n", "component", "own", "text", F.explode("others").alias("other"))
    tiles = texts.select(
        F.concat_ws("/", "component", F.least("own", "other"), F.greatest("own", "other")).alias("tile"),
        (F.col("own") > F.col("other")).alias("guest"), "id", "n", "text",
    )
    found = stage(tiles.groupBy("tile").applyInArrow(lambda t: _verify(t, n, threshold), "id long, links long, root long"))
    component = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    each = stage(
        classes.select("set_key", "id", "n").join(links, "id", "left").join(component, "id", "left")
        .select("set_key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    keyed = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    return keyed.join(each, "set_key", "left").select(
        "doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )
