"""The pressure-guided plan: batches grow as rows get shorter.

Where a batch starts depends on where the last one ended, so the walk is sequential. It runs in a grouped map over numbers
only (no text), on prefix sums built once; plan_key splits the corpus into independent plans that run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchplan.functions.sizes import candidate_grid, even_floor, friendly_floor, growth_step, round_sizes, size_cap, smooth
from batchplan.operators.plans import positions


@dataclass(frozen=True)
class PlanConfig:
    batch_size: int = 32
    max_range: float = 2.0
    threshold: float = 0.9
    smooth: bool = True
    smooth_max_diff: float = 0.2
    friendly: bool = False
    even: bool = True
    dynamic: bool = True
    pressure: str | Callable = "token_sum"

    def __post_init__(self):
        if self.batch_size < 1:
            raise ValueError("batch_size must be positive")

    @property
    def growth(self) -> int:
        """0 disables growth between batches when smoothing."""
        return growth_step(self.batch_size, size_cap(self.batch_size, self.max_range), self.smooth_max_diff)


def walk(token: np.ndarray, word: np.ndarray, char: np.ndarray, config: PlanConfig) -> list[int]:
    """Sizes of consecutive batches over rows sorted longest first."""
    n, size = len(token), config.batch_size
    grid = np.array(candidate_grid(size, config.max_range))
    sums = {k: np.concatenate(([0], np.cumsum(v))) for k, v in (("token", token), ("word", word), ("char", char))}
    first = min(size, n)
    base = {f"{k}_sum": s[first] for k, s in sums.items()} | {"token_max": token[0] if n else 0, "word_max": word[:first].max() if n else 0}
    sizes, at = ([first] if n else []), first
    while at < n:
        end = np.minimum(at + grid, n)
        if config.pressure == "token_sum":
            found = (sums["token"][end] - sums["token"][at]) / base["token_sum"] if base["token_sum"] else np.zeros(len(grid))
        elif config.pressure == "padded_area":
            area = size * base["token_max"]
            found = grid * token[at] / area if area else np.zeros(len(grid))
        elif callable(config.pressure):
            counts = end - at
            table = {"batch_size_y": grid, "token_max_y": np.full(len(grid), token[at]), "word_max_y": np.array([word[at:e].max() for e in end])}
            for k, s in sums.items():
                table[f"{k}_sum_y"] = s[end] - s[at]
                table[f"{k}_mean_y"] = table[f"{k}_sum_y"] / counts
            found = np.asarray(config.pressure(pd.DataFrame(table), {"batch_size": size, "rows": first, **base}))
        else:
            found = np.full(len(grid), float(str(config.pressure).split(":")[1]))
        passing = grid[found <= config.threshold]
        sizes.append(int(min(passing.max() if len(passing) else size, n - at)))
        at += sizes[-1]
    return sizes


def stages(token: np.ndarray, word: np.ndarray, char: np.ndarray, config: PlanConfig) -> dict[str, list[int]]:
    """Sizes after the walk, after smoothing and after rounding."""
    if not config.dynamic:
        fixed = [config.batch_size] * (len(token) // config.batch_size) + ([len(token) % config.batch_size] if len(token) % config.batch_size else [])
        return {"raw": fixed, "smooth": fixed, "final": fixed}
    raw = walk(token, word, char, config)
    smoothed = smooth(raw, config.batch_size, size_cap(config.batch_size, config.max_range), config.smooth_max_diff) if config.smooth else raw
    final = smoothed
    for wanted, floor in ((config.friendly, friendly_floor), (config.even, even_floor)):
        final = round_sizes(final, floor) if wanted else final
    return {"raw": raw, "smooth": smoothed, "final": final}


def _grouped(lengths: DataFrame, plan_key: str | None):
    key = F.col(plan_key).cast("string") if plan_key else F.lit("")
    return lengths.select(key.alias("plan_key"), "idx", "token_len", "word_len", "char_len").groupBy("plan_key")


def plan_sizes(lengths: DataFrame, config: PlanConfig, plan_key: str | None = None) -> DataFrame:
    """(plan_key, stage, batch_id, size): the trace of sizes by stage."""

    def trace(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["token_len", "idx"], ascending=[False, True])
        found = stages(*(rows[c].to_numpy(np.int64) for c in ("token_len", "word_len", "char_len")), config)
        return pd.DataFrame([(key[0], stage, k, s) for stage, sizes in found.items() for k, s in enumerate(sizes)], columns=["plan_key", "stage", "batch_id", "size"])

    return _grouped(lengths, plan_key).applyInPandas(trace, "plan_key string, stage string, batch_id bigint, size bigint")


def dynamic_plan(lengths: DataFrame, config: PlanConfig = PlanConfig(), plan_key: str | None = None) -> DataFrame:
    """(plan_key, batch_id, slot, idx). An empty table gives an empty plan."""

    def place(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["token_len", "idx"], ascending=[False, True])
        sizes = np.array(stages(*(rows[c].to_numpy(np.int64) for c in ("token_len", "word_len", "char_len")), config)["final"], np.int64)
        batch = np.repeat(np.arange(len(sizes)), sizes)
        slot = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return pd.DataFrame({"plan_key": key[0], "batch_id": batch, "slot": slot, "idx": rows["idx"].to_numpy()})

    return _grouped(lengths, plan_key).applyInPandas(place, "plan_key string, batch_id bigint, slot bigint, idx bigint")


def plan(corpus_lengths: DataFrame, *, plan_key: str | None = None, **options) -> DataFrame:
    """The plan of a length table under options of PlanConfig."""
    return dynamic_plan(corpus_lengths, replace(PlanConfig(), **options), plan_key)


def plan_violations(plan: DataFrame, lengths: DataFrame, cap: int) -> DataFrame:
    """One row of counts that are 0 for a sound plan: ids missing, ids planned twice, batches over the cap, slots that leave gaps."""
    planned = plan.groupBy("idx").agg(F.count("*").alias("k"))
    both = lengths.select("idx", F.lit(1).alias("here")).join(planned, "idx", "full").agg(F.count_if(F.col("k").isNull()).alias("missing"), F.count_if((F.col("k") > 1) | F.col("here").isNull()).alias("repeated"))
    sizes = plan.groupBy("batch_id").agg(F.count("*").alias("n"), F.max("slot").alias("top"))
    return both.join(F.broadcast(sizes.agg(F.count_if(F.col("n") > cap).alias("oversize"), F.count_if(F.col("top") + 1 != F.col("n")).alias("gaps"))))  # one row each


def epoch(plan: DataFrame, number: int, *, seed: int = 21, keep_first: int = 3) -> DataFrame:
    """(epoch, place, batch_id, slot, idx) of an epoch: batches in a seeded order, rows within each shuffled.

    In epoch 0 the first keep_first batches keep their places, if there are more batches than that. The order depends on the
    plan, the seed and the number alone.
    """
    ids = plan.select("batch_id").distinct()
    n = ids.count()
    pinned = F.col("batch_id") < keep_first if number == 0 and n > keep_first else F.lit(False)
    # The hash of a batch_id under a fixed seed is unlike that of any other, so it is an order; positions() spreads it over its ranges.
    hashed = ids.select("batch_id", F.when(pinned, F.col("batch_id")).otherwise(keep_first).alias("pin"), F.xxhash64(F.lit(seed), F.lit(number), "batch_id").alias("idx"))
    ordered = positions(hashed, "pin", descending=False).select("batch_id", F.col("pos").alias("place"))
    within = Window.partitionBy("batch_id").orderBy(F.xxhash64(F.lit(seed), F.lit(number), F.lit("rows"), "idx"), "idx")
    rows = plan.join(ordered, "batch_id")
    return rows.select(F.lit(number).cast("bigint").alias("epoch"), F.col("place").cast("bigint").alias("place"), "batch_id", (F.row_number().over(within) - 1).cast("bigint").alias("slot"), "idx")


def budget_sizes(token: list[int], start: int, chance: float = 0.0, seed: int = 21, fails: Callable[[int, int], bool] = lambda size, longest: False) -> list[tuple[int, bool]]:
    """(size, failed) of exploratory batches over rows sorted longest first, so that each holds about the tokens of the first.

    After a failure the size shrinks by a quarter, to 1 at least, and the rows are tried again; a failing single row is left out.
    """
    rng = np.random.default_rng(seed)
    out, at, budget, working, highest, size = [], 0, None, None, 0, start
    while at < len(token):
        if budget:
            base = working or start
            size = max(int(base * (1 + (budget - token[at] * base) / budget)), highest, 1)
            size += int(rng.random() < chance)
        size = min(size, len(token) - at)
        while fails(size, token[at]):
            out.append((size, True))
            highest = 0
            if size == 1:
                at, size = at + 1, 0
                break
            size = max(1, int(size * 0.75))
        if size:
            out.append((size, False))
            budget = budget or sum(token[at : at + size])
            working, highest, at = size, max(highest, size), at + size
        else:
            size = max(1, working or 1)
    return out
