"""Best-fit packing by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.wordbpe import library_ids

#: Texts handled together inside a worker.
TOGETHER = 500


def fill(counts: dict[int, int], capacity: int) -> Iterator[list[int]]:
    """Bins of lengths from the multiset ``counts``, each the fullest that its largest remaining length allows.

    A bin takes the largest length left; over the others, largest first, a bitset holds the sums that can be reached
    (bit s: s tokens), and the best one is traced back through the bitsets. What a bin takes is removed.
    """
    left = dict(counts)
    order = sorted(left, reverse=True)
    while order:
        first = order[0]
        left[first] -= 1
        room = capacity - first
        mask, goal = (1 << (room + 1)) - 1, 1 << room
        reach, steps = 1, []
        for n in order:
            if n > room:
                continue
            for _ in range(min(left[n], room // n)):
                wider = (reach | reach << n) & mask
                if wider == reach:
                    break
                steps.append((n, reach))
                reach = wider
            if reach & goal:
                break
        best, taken = reach.bit_length() - 1, [first]
        for n, was in reversed(steps):
            if not was >> best & 1:
                best -= n
                taken.append(n)
                left[n] -= 1
        yield taken
        if any(not left[n] for n in set(taken)):
            order = [n for n in order if left[n]]


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Token ids of every text and then ``end_id``, cut every ``capacity`` tokens.

    docs: doc_id, text; a null text is empty and so gives the one token ``end_id``. Returns doc_id, piece, start,
    length, ids_crc32 and, unless ``with_ids`` is false, ids (little-endian unsigned 32-bit).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, last = library_ids(path), end_id.to_bytes(4, "little")
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(lo, TOGETHER)
                row, piece, start, blob = [], [], [], []
                for i, b in enumerate(ids.of(some.column(1).to_pylist())):
                    b += last
                    for k, at in enumerate(range(0, len(b), 4 * capacity)):
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        blob.append(b[at : at + 4 * capacity])
                columns = [
                    some.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array([len(b) // 4 for b in blob], pa.int64()), pa.array([zlib.crc32(b) for b in blob], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(blob, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, schema)


def pack(cut: DataFrame, n_groups: int, capacity: int = 2048) -> DataFrame:
    """Place rows with a ``length`` (1 to ``capacity``) into sequences; adds sequence_id and offset.

    Rows are dealt by hash into ``n_groups`` groups that are packed each on its own, so that a task holds one group;
    every group leaves at most a few open sequences. Equal rows may swap places. An empty table stays empty.
    """
    columns = cut.columns

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", *[c for c in ("doc_id", "piece") if c in columns]], kind="stable").reset_index(drop=True)
        length = rows["length"].to_numpy()
        at = {int(n): list(np.flatnonzero(length == n)[::-1]) for n in np.unique(length)}
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, taken in enumerate(fill({n: len(x) for n, x in at.items()}, capacity)):
            here = 0
            for n in taken:
                i = at[n].pop()
                sequence[i], offset[i] = k, here
                here += n
        rows["sequence_id"] = rows.pop("pack_group").astype("int64") * (1 << 32) + sequence
        rows["offset"] = offset
        return rows

    keyed = cut.withColumn("pack_group", F.pmod(F.xxhash64(*columns), F.lit(n_groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return keyed.groupBy("pack_group").applyInPandas(place, f"{schema}, sequence_id long, offset long")


def groups_for(docs: DataFrame, rows_in_group: int = 8192, bytes_in_group: int = 1 << 25) -> int:
    """How many groups keep each near ``rows_in_group`` texts and ``bytes_in_group`` of text."""
    got = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b")).first()
    return max(1, -(-got["n"] // rows_in_group), -(-(got["b"] or 0) // bytes_in_group))


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text; other columns are ignored).

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Texts are tokenised once, where
    they are read; only lengths, checksums and numbers are shuffled.
    """
    docs = docs.select("doc_id", "text")
    return pack(pieces(docs, path, capacity, end_id, with_ids=False), groups_for(docs), capacity)
