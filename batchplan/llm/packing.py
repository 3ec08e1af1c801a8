"""Packing token sequences by exact-complement hashing, with best-fit for what is left.

Only the histogram of piece lengths decides the packing: at most `capacity` counts, whatever the corpus. On it, from the
longest length down, the gap to the capacity is looked up among single lengths, sums of pairs and sums of triples, and
each combination that fills the gap exactly is consumed as often as the counts allow. What finds no exact complement
goes through best-fit decreasing, also by counts. The outcome is a short list of (pattern, times); pieces get a rank among
those of their length, and the rank says which copy of which pattern they stand in.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchplan.llm.spark_io import freeing, settled
from batchplan.llm.tokens import encoder, in_blocks

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; every counted piece is in exactly one.

    An empty histogram gives no patterns; lengths outside 1..capacity are an error.
    """
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("a length is not in 1..capacity")
    have = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        have[n] = k
    plan: list[tuple[tuple[int, ...], int]] = []

    def consume(pattern: tuple[int, ...]) -> None:
        need = np.bincount(pattern, minlength=capacity + 1)
        times = int(min(have[n] // need[n] for n in set(pattern)))
        if times:
            have[list(set(pattern))] -= times * need[list(set(pattern))]
            plan.append((pattern, times))

    def pair(gap: int, most: int) -> tuple[int, int] | None:
        """The available pair of this sum whose larger member is largest but at most `most`."""
        if gap < 2:
            return None
        b = np.arange(min(most, gap - 1), (gap + 1) // 2 - 1, -1)
        fit = np.flatnonzero((have[b] > 0) & (have[gap - b] > (b == gap - b)))
        return (int(b[fit[0]]), int(gap - b[fit[0]])) if len(fit) else None

    if have[capacity]:
        consume((capacity,))
    for n in range(capacity - 1, 0, -1):
        gap = capacity - n
        if have[n] and have[gap]:
            consume((n, gap))
        while have[n]:
            have[n] -= 1  # the piece itself does not fill its own gap
            found = pair(gap, n)
            have[n] += 1
            if found is None:
                break
            before = have[n]
            consume((n, *found))
            if have[n] == before:
                break
        while have[n]:
            have[n] -= 1
            found = None
            for a in np.flatnonzero(have[: min(n, gap - 2) + 1])[::-1] if gap > 2 else ():
                have[a] -= 1
                rest = pair(gap - int(a), int(a))
                have[a] += 1
                if rest is not None:
                    found = (n, int(a), *rest)
                    break
            have[n] += 1
            if found is None:
                break
            before = have[n]
            consume(found)
            if have[n] == before:
                break

    open_bins: dict[int, list[list]] = {}  # gap -> [pattern, times]
    for n in range(capacity, 0, -1):
        left = int(have[n])
        while left:
            gap = next((g for g in range(n, capacity) if open_bins.get(g)), None)
            if gap is not None:
                pattern, times = open_bins[gap].pop()
                used = min(times, left)
                if times > used:
                    open_bins[gap].append([pattern, times - used])
                open_bins.setdefault(gap - n, []).append([(*pattern, n), used])
                left -= used
            else:  # new sequences, each filled with as many of this length as fit
                each = capacity // n
                if left >= each:
                    open_bins.setdefault(capacity - each * n, []).append([(n,) * each, left // each])
                    left %= each
                if left:
                    open_bins.setdefault(capacity - left * n, []).append([(n,) * left, 1])
                    left = 0
    plan += [(tuple(p), t) for bins in open_bins.values() for p, t in bins]
    return plan


def pieces(docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's token ids with end_id behind, cut into pieces of at most capacity: whole ones, the first may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path)
        for b in batches:
            texts, own = b.column(1).to_pylist(), b.column(0).to_pylist()
            for first, stop in in_blocks(texts):
                flat, n = enc.encode_many(texts[first:stop])
                flat = np.insert(flat, np.cumsum(n), end_id).astype("<u4")
                out: list[list[int]] = [[], [], [], [], []]
                at = 0
                for doc, size in zip(own[first:stop], (n + 1).tolist(), strict=True):
                    start, piece = 0, 0
                    while start < size:
                        end = start + ((size - start) % capacity or capacity)
                        for c, v in zip(out, (doc, piece, start, end - start, zlib.crc32(flat[at + start : at + end].tobytes())), strict=True):
                            c.append(v)
                        start, piece = end, piece + 1
                    at += size
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(out)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(freeing(cut, hands_on=True), PIECE).withColumnRenamed("doc_id", id_col)


def pack(docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int = 2048, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece.

    Null and empty texts are the end id alone. Repeated rows are packed one by one; documents of equal id are packed apart.
    Very long texts give many pieces. An empty table gives an empty result. Only the histogram (at most capacity
    rows) goes to the driver and only the allocation table, bounded by it, to the tasks; ranks within a length are
    dealt over salted groups, so a length that holds most pieces is spread.
    """
    cut = settled(pieces(docs, vocabulary_path, end_id, capacity, id_col=id_col, text_col=text_col))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    ranked: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan_packing(counts, capacity):
        offset = 0
        for n in pattern:
            rank = ranked.get(n, 0)
            by_length.setdefault(n, []).append((rank, sequence, offset))
            ranked[n] = rank + times
            offset += n
        sequence += times
    table = {n: np.array(a, np.int64).T.copy() for n, a in by_length.items()}
    shared = cut.sparkSession.sparkContext.broadcast(table)

    salts = max(256, sum(counts.values()) // 20_000)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy(id_col, "piece", "ids_crc32")
    rows = salted.withColumn("own", F.row_number().over(within) - 1).join(bases, ["length", "salt"])
    rows = rows.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                starts, sequences, offsets = shared.value[int(n)]
                k = np.searchsorted(starts, rank[own], "right") - 1
                seq[own], off[own] = sequences[k] + rank[own] - starts[k], offsets[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return rows.mapInArrow(freeing(place), f"{PIECE}, sequence_id long, offset long").withColumnRenamed("doc_id", id_col)
