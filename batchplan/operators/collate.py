"""From plans to padded batches, splitting and merging them, and running them with a fallback when memory is short."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def padded(ids: Column, width: Column, pad: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad).cast("bigint"), (width - F.size(ids)).cast("int")))


def collate(plan: DataFrame, tokens: DataFrame, *, pad: int = 0, multiple_of: int = 1) -> DataFrame:
    """(batch_id, input_ids, attention_mask, texts): each batch padded to its longest row, the width rounded up to a multiple.

    tokens: (idx, ids, text). A batch is as large as the plan makes it, so a group is bounded by the plan's largest size.
    """
    rows = plan.join(tokens, "idx").groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("slot", "ids", "text"))).alias("rows"), (F.ceil(F.max(F.size("ids")) / multiple_of) * multiple_of).alias("width"))
    ids = F.transform("rows", lambda r: padded(r.ids, F.col("width"), pad))
    mask = F.transform("rows", lambda r: F.concat(F.array_repeat(F.lit(1), F.size(r.ids)), F.array_repeat(F.lit(0), (F.col("width") - F.size(r.ids)).cast("int"))))
    return rows.select("batch_id", ids.alias("input_ids"), mask.alias("attention_mask"), F.transform("rows", lambda r: r.text).alias("texts"))


def split_plan(plan: DataFrame, chunk: int) -> DataFrame:
    """The plan with chunk_id: batches cut into chunks of at most `chunk` rows."""
    if chunk < 1:
        raise ValueError("chunk must be positive")
    return plan.withColumn("chunk_id", F.floor(F.col("slot") / chunk).cast("bigint"))


def split_inputs(inputs: dict, chunk: int, key: str = "input_ids") -> list[dict]:
    """A batch as a dict, cut along its rows: values with one entry for each row of `key` are sliced, others go into every chunk."""
    if chunk < 1:
        raise ValueError("chunk must be positive")
    if key not in inputs:
        raise KeyError(key)
    n = len(inputs[key])
    sliced = {k for k, v in inputs.items() if hasattr(v, "__len__") and not isinstance(v, str | dict) and len(v) == n}
    return [{k: v[at : at + chunk] if k in sliced else v for k, v in inputs.items()} for at in range(0, n, chunk)]


def split_batch(batch: dict, chunk: int) -> list[dict]:
    """A batch as a dict of columns, every one of them sliced."""
    if chunk < 1:
        raise ValueError("chunk must be positive")
    return [{k: v[at : at + chunk] for k, v in batch.items()} for at in range(0, len(batch["input_ids"]), chunk)]


def merge_outputs(outputs: list[DataFrame], pad: int, *, ids_col: str = "ids") -> DataFrame | None:
    """The rows of all outputs with their ids padded to the widest of all; without outputs, None."""
    if not outputs:
        return None
    rows = outputs[0]
    for more in outputs[1:]:
        rows = rows.unionByName(more)
    width = rows.agg(F.max(F.size(ids_col)).alias("__width"))
    return rows.join(F.broadcast(width)).withColumn(ids_col, padded(F.col(ids_col), F.col("__width"), pad)).drop("__width")  # one row


def resolve_pad(*candidates: int | None) -> int:
    """The first pad id that is set."""
    for c in candidates:
        if c is not None:
            return c
    raise ValueError("no pad id is set")


def run_batches(batches: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *, smallest: int = 1, failure: type[BaseException] = MemoryError) -> DataFrame:
    """Run work on each batch; if it fails for memory, on chunks of `smallest` rows of that batch alone, in order.

    batches: one row for each item with batch_id and slot. The result has a column did_fallback. A failure of a chunk ends the job.
    """

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slot")
        try:
            return work(rows).assign(did_fallback=False)
        except failure:
            parts = [work(rows.iloc[at : at + smallest]) for at in range(0, len(rows), smallest)]
            return pd.concat(parts).assign(did_fallback=True)

    return batches.groupBy("batch_id").applyInPandas(whole, f"{schema}, did_fallback boolean")


def fallback_chunks(totals: DataFrame, budget: int, smallest: int) -> DataFrame:
    """(batch_id, n, did_fallback, chunks) under a memory model: a batch whose padded area is over the budget runs in chunks of `smallest` rows."""
    over = F.col("n") * F.col("token_max") > budget
    return totals.select("batch_id", "n", over.alias("did_fallback"), F.when(over, F.ceil(F.col("n") / smallest)).otherwise(1).cast("bigint").alias("chunks"))


def stream_batches(batches: DataFrame) -> Iterator:
    """The batches one after another on the driver, a partition at a time."""
    return batches.orderBy("batch_id").toLocalIterator(prefetchPartitions=True)


def timed(batches: DataFrame) -> tuple[int, float]:
    """(rows, seconds) of computing every row on the executors; nothing is kept or sent to the driver but the count."""
    seen = Observation()
    started = time.monotonic()
    batches.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return seen.get["rows"], time.monotonic() - started
