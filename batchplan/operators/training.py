"""Learning-rate, loss and step arithmetic for batches of varying size, and the retry policies of a training step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = (None, "skip", "split_retry")


def scaled_rate(rate: float, rows: int, base: int, batches: int) -> float:
    """rate * max(1, rows // base) / max(1, batches)."""
    if base <= 0:
        raise ValueError("the base batch size must be positive")
    return rate * max(1, rows // base) / max(1, batches)


def rate_scale(plan: DataFrame, base: int, rate: float) -> DataFrame:
    """(rows, batches, scaled) of a plan."""
    if base <= 0:
        raise ValueError("the base batch size must be positive")
    counts = plan.agg(F.count("*").alias("rows"), F.count_distinct("batch_id").alias("batches"))
    return counts.withColumn("scaled", F.lit(rate) * F.greatest(F.lit(1), F.floor(F.col("rows") / base)) / F.greatest(F.lit(1), F.col("batches")))


def auto_rate(plan: DataFrame | None, base: int, rate: float, enabled: bool = False) -> DataFrame | float:
    """The rate as given, or, asked for, that of rate_scale(); without a plan to scale by an error."""
    if not enabled:
        return rate
    if plan is None:
        raise ValueError("scaling a rate needs a plan")
    return rate_scale(plan, base, rate)


def batch_size_by_key(batches: DataFrame, key: str) -> DataFrame:
    """(batch_id, size): the first dimension of the column `key` of collated batches; an error if there is no such column."""
    if key not in batches.columns:
        raise KeyError(key)
    return batches.select("batch_id", F.size(key).cast("bigint").alias("size"))


def step_scale(plan: DataFrame, base: int, steps: int) -> DataFrame:
    """(batches, static_batches, steps): an interval of steps of the fixed-size plan in steps of this one, 1 at least."""
    counts = plan.agg(F.count("*").alias("rows"), F.count_distinct("batch_id").alias("batches"))
    counts = counts.withColumn("static_batches", F.ceil(F.col("rows") / base).cast("bigint"))
    return counts.select("batches", "static_batches", F.greatest(F.lit(1), F.floor(F.lit(steps) * F.col("batches") / F.col("static_batches"))).cast("bigint").alias("steps"))


def loss_weight(size: Column, expected: int, accumulation: int, total: Column | None = None) -> Column:
    """What a loss is multiplied by: with accumulation its rows over the expected ones; in a fallback without accumulation over the whole batch's; else 1."""
    if accumulation > 1:
        return size / F.lit(float(expected))
    return size / total if total is not None else F.lit(1.0)


def retry_step(chunks: DataFrame, policy: str | None, expected: int, accumulation: int) -> DataFrame:
    """(step, loss, failures) after failures of memory. chunks: (step, size, loss, failed), one row for each chunk of the steps whose first attempt
    failed; steps that ran are not to be given.

    split_retry adds up the weighted losses of the chunks that ran, failed ones are only counted; skip gives loss 0 for the step.
    Failures count the step's first one too. Without a policy a failure is an error.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    if policy is None:
        raise MemoryError("a step failed and there is no policy")
    totals = chunks.groupBy("step").agg(F.sum("size").alias("total"))
    rows = chunks.join(totals, "step").withColumn("weighted", F.col("loss") * loss_weight(F.col("size"), expected, accumulation, F.col("total")))
    ran = F.coalesce(F.sum(F.when(~F.col("failed"), F.col("weighted"))), F.lit(0.0))
    if policy == "skip":
        return rows.groupBy("step").agg(F.lit(0.0).alias("loss"), F.lit(1).cast("bigint").alias("failures"))
    return rows.groupBy("step").agg(ran.alias("loss"), (F.count_if("failed") + 1).alias("failures"))


def smallest_chunk(explicit: int | None, planned: int | None) -> int:
    """The explicit chunk size if it is positive, else the plan's smallest batch, 1 at least."""
    if explicit is not None and explicit > 0:
        return explicit
    return max(1, planned or 1)
