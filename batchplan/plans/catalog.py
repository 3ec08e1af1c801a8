"""Registered queries of the planning engine and their DuckDB oracles.

Every query runs over a whole table of a scale-factor folder; B and LIMIT are the batch size and the token limit that the
queries plan with.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchplan.functions.sizes import even_floor_column, friendly_floor_column
from batchplan.operators import collate, features, lengths, offline, plans, training
from batchplan.operators.dynamic import PlanConfig, dynamic_plan, epoch, plan, plan_sizes, plan_violations

B, LIMIT, RANGE, THRESHOLD = 16, 512, 2.0, 0.9
GRID = features.candidate_grid(B, RANGE)
WEIGHTS = [(0.0, 0.5, 2.0), (0.5, 0.9, 1.0), (0.9, 1.1, 5.0), (1.1, 2.0, 3.0)]

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _lens(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return lengths.whitespace_lengths(_docs(spark, sf_dir), LIMIT, keep=keep)


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.positions(_lens(spark, sf_dir).drop("text"))


def _static(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    known = _lens(spark, sf_dir).drop("text")
    return plans.static_plan(known, B), known


UNITS = r"units AS (SELECT doc_id AS idx, lang, source, coalesce(text, '') AS full_text, regexp_extract_all(coalesce(text, ''), '[ \t\n\r\f]*[^ \t\n\r\f]+') AS u FROM documents)"


def _len_cte(limit: int, special: int = 0) -> str:
    return f"{UNITS}, len AS (SELECT idx, lang, source, CAST(least({limit - special}, len(u)) + {special} AS BIGINT) AS token_len, CAST(least({limit - special}, len(u)) AS BIGINT) AS word_len, CAST(length(array_to_string(u[1:{limit - special}], '')) AS BIGINT) AS char_len, coalesce(array_to_string(u[1:{limit - special}], ''), '') AS text FROM units)"


LEN = _len_cte(LIMIT)
POS = f"{LEN}, ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY token_len DESC, idx) - 1 AS BIGINT) AS pos FROM len)"
STATIC = f"{POS}, plan AS (SELECT pos // {B} AS batch_id, pos % {B} AS slot, idx, token_len, word_len, char_len FROM ranked)"
TOTALS = f"{STATIC}, totals AS (SELECT batch_id, count(*) AS n, CAST(sum(token_len) AS BIGINT) AS token_sum, max(token_len) AS token_max, CAST(count(*) * max(token_len) - sum(token_len) AS BIGINT) AS padding FROM plan GROUP BY batch_id)"
GRID_CTE = "grid AS (SELECT CAST(unnest([{}]) AS BIGINT) AS c)"


def _walk_cte(pressure: str = "token_sum", part: str = "''", b: int = B) -> str:
    """The greedy walk as a recursive CTE: opt has the size that each position would take, walk hops along it."""
    area = "CAST(c * p.token_len AS DOUBLE) / ({b} * base.top)".format(b=b)
    ratio = "(coalesce(e.before, t.total) - p.before) / CAST(base.s AS DOUBLE)" if pressure == "token_sum" else area
    return f"""{LEN}, r AS (SELECT {part} AS k, idx, token_len, row_number() OVER (PARTITION BY {part} ORDER BY token_len DESC, idx) - 1 AS pos FROM len),
s AS (SELECT *, sum(token_len) OVER (PARTITION BY k ORDER BY pos) - token_len AS before, count(*) OVER (PARTITION BY k) AS n FROM r),
t AS (SELECT k, sum(token_len) AS total, count(*) AS n FROM s GROUP BY k),
base AS (SELECT k, sum(token_len) AS s, max(token_len) AS top FROM s WHERE pos < {b} GROUP BY k),
{GRID_CTE.format(", ".join(map(str, GRID)))},
opt AS (SELECT p.k, p.pos, least(coalesce(max(CASE WHEN {ratio} <= {THRESHOLD} THEN c END), {b}), max(t.n) - p.pos) AS size FROM s p JOIN t ON t.k = p.k JOIN base ON base.k = p.k CROSS JOIN grid LEFT JOIN s e ON e.k = p.k AND e.pos = p.pos + c GROUP BY p.k, p.pos),
walk(k, batch_id, p0, size) AS (SELECT k, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(least({b}, n) AS BIGINT) FROM t UNION ALL SELECT w.k, w.batch_id + 1, w.p0 + w.size, CAST(o.size AS BIGINT) FROM walk w JOIN opt o ON o.k = w.k AND o.pos = w.p0 + w.size)"""


CAP, STEP = int(RANGE * B), PlanConfig(batch_size=B, max_range=RANGE).growth
#: The smoothing fold, carrying (i, size, carry); after the last size it drains what is carried.
SMOOTH = f"""{_walk_cte()}, cnt AS (SELECT count(*) AS m FROM walk),
smooth(i, size, carry) AS (SELECT CAST(0 AS BIGINT), CAST(least(size, {CAP}) AS BIGINT), CAST(size - least(size, {CAP}) AS BIGINT) FROM walk WHERE batch_id = 0
UNION ALL SELECT x.i, CAST(least(x.wanted, x.last + {STEP}, {CAP}) AS BIGINT), CAST(x.wanted - least(x.wanted, x.last + {STEP}, {CAP}) AS BIGINT) FROM (SELECT f.i + 1 AS i, f.size AS last, coalesce(w.size, 0) + f.carry AS wanted FROM smooth f LEFT JOIN walk w ON w.batch_id = f.i + 1 CROSS JOIN cnt WHERE f.i + 1 < cnt.m OR f.carry > 0) x)"""


def _rounded(before: str, source: str, name: str, floor: str) -> str:
    """The rounding fold: floors of all sizes but the last, then what is left is regrouped under the largest size."""
    f = floor.format
    head = f"{name}_head AS (SELECT i, {f('size')} AS size FROM {source} WHERE i < (SELECT max(i) FROM {source}))"
    rest = f"{name}_rest AS (SELECT max(size) AS cap, sum(size) - coalesce((SELECT sum(size) FROM {name}_head), 0) AS todo, max(i) AS i FROM {source})"
    first = f("least(todo, cap)")
    later = f("least(todo, cap)")
    tail = f"""{name}_tail(i, size, todo, cap) AS (SELECT CAST(i AS BIGINT), CAST({first} AS BIGINT), CAST(todo - {first} AS BIGINT), CAST(cap AS BIGINT) FROM {name}_rest
UNION ALL SELECT i + 1, CAST(CASE WHEN todo <= cap THEN todo ELSE {later} END AS BIGINT), CAST(todo - CASE WHEN todo <= cap THEN todo ELSE {later} END AS BIGINT), cap FROM {name}_tail WHERE todo > 0)"""
    return f"{before}, {head}, {rest}, {tail}, {name} AS (SELECT CAST(i AS BIGINT) AS i, CAST(size AS BIGINT) AS size FROM {name}_head UNION ALL SELECT i, size FROM {name}_tail)"


EVEN_SQL = "(CASE WHEN {0} = 1 THEN 1 ELSE {0} - {0} % 2 END)"
FRIENDLY_SQL = "greatest(CAST(pow(2, floor(log2({0}))) AS BIGINT), CASE WHEN {0} >= 3 THEN CAST(3 * pow(2, floor(log2({0} / 3.0))) AS BIGINT) ELSE 0 END)"
EVENED = _rounded(SMOOTH, "smooth", "evened", EVEN_SQL)
FRIENDLY = _rounded(SMOOTH, "smooth", "friendly", FRIENDLY_SQL)
FULL = _rounded(FRIENDLY, "friendly", "full_plan", EVEN_SQL)


# Lengths and order
@_query(f"WITH {_len_cte(1 << 30)} SELECT idx, token_len, word_len, char_len FROM len")
def lengths_ws(spark, d):
    return lengths.whitespace_lengths(_docs(spark, d), 1 << 30).drop("text")


@_query(f"WITH {LEN} SELECT idx, token_len, word_len, char_len, md5(text) AS text_md5 FROM len")
def lengths_ws_truncated(spark, d):
    return _lens(spark, d).withColumn("text_md5", F.md5("text")).drop("text")


@_query(f"WITH {_len_cte(LIMIT, 2)} SELECT idx, token_len, word_len, char_len FROM len")
def lengths_specials(spark, d):
    return lengths.whitespace_lengths(_docs(spark, d), LIMIT, special_tokens=2).drop("text")


@_query(
    rf"""WITH {UNITS}, dec AS (SELECT idx, full_text, len(u) AS m, length(array_to_string(list_transform(u[1:{LIMIT}], lambda x: regexp_replace(x, '^[ \t\n\r\f]+', '')), ' ')) AS e FROM units)
SELECT idx, CAST(least({LIMIT}, m) AS BIGINT) AS token_len, CAST(CASE WHEN coalesce(e, 0) < length(full_text) THEN coalesce(e, 0) + length(regexp_extract(substring(full_text, coalesce(e, 0) + 1), '^[ \t\n\r\f]*')) ELSE length(full_text) END AS BIGINT) AS char_len FROM dec"""
)
def lengths_decode(spark, d):
    return lengths.whitespace_lengths(_docs(spark, d), LIMIT, strategy="decode").select("idx", "token_len", "char_len")


@_query("SELECT doc_id AS idx, CAST(len(string_split(text, ' ')) AS BIGINT) AS word_len, CAST(length(text) AS BIGINT) AS char_len FROM documents")
def lengths_offline(spark, d):
    return lengths.offline_lengths(_docs(spark, d))


@_query(f"WITH {LEN} SELECT len.idx, token_len, word_len, char_len, CAST(length(full_text) AS BIGINT) AS whole FROM len JOIN units USING (idx)")
def lengths_precomputed(spark, d):
    known = _lens(spark, d).drop("text")
    return lengths.precomputed_lengths(_docs(spark, d), known).select("idx", "token_len", "word_len", "char_len", F.length("text").cast("bigint").alias("whole"))


@_query(f"WITH {POS} SELECT pos, idx, token_len FROM ranked")
def sorted_positions(spark, d):
    return _ranked(spark, d).select("pos", "idx", "token_len")


# Plans of fixed size
@_query(f"WITH {STATIC} SELECT batch_id, slot, idx FROM plan")
def plan_static(spark, d):
    return _static(spark, d)[0]


@_query(f"WITH {LEN} SELECT (row_number() OVER (ORDER BY idx) - 1) // {B} AS batch_id, (row_number() OVER (ORDER BY idx) - 1) % {B} AS slot, idx FROM len")
def plan_normal(spark, d):
    return plans.normal_plan(_lens(spark, d), B)


@_query(f"WITH {LEN} SELECT (row_number() OVER (ORDER BY char_len, idx) - 1) // {B} AS batch_id, (row_number() OVER (ORDER BY char_len, idx) - 1) % {B} AS slot, idx FROM len")
def plan_bucket(spark, d):
    return plans.bucket_plan(_lens(spark, d), B)


@_query(
    f"""WITH {LEN}, p AS (SELECT 'normal' AS strategy, (row_number() OVER (ORDER BY idx) - 1) // {B} AS b, token_len FROM len UNION ALL SELECT 'bucket', (row_number() OVER (ORDER BY char_len, idx) - 1) // {B}, token_len FROM len UNION ALL SELECT 'max_token', (row_number() OVER (ORDER BY token_len DESC, idx) - 1) // {B}, token_len FROM len),
g AS (SELECT strategy, b, count(*) * max(token_len) AS area, sum(token_len) AS used FROM p GROUP BY ALL)
SELECT strategy, count(*) AS batches, CAST(sum(area) AS BIGINT) AS area, CAST(sum(used) AS BIGINT) AS used, CAST(sum(area) - sum(used) AS BIGINT) AS padding FROM g GROUP BY strategy"""
)
def padding_by_strategy(spark, d):
    known = _lens(spark, d).drop("text")
    made = {"normal": plans.normal_plan, "bucket": plans.bucket_plan, "max_token": plans.static_plan}
    return reduce(DataFrame.unionByName, [plans.padding_totals(f(known, B), known, name) for name, f in made.items()])


@_query(f"WITH {TOTALS} SELECT * FROM totals")
def batch_totals(spark, d):
    return plans.batch_totals(*_static(spark, d))


# Statistics and features
@_query(f"WITH {STATIC} SELECT batch_id, count(*) AS n, round(avg(token_len), 6) AS token_len_mean, round(stddev_pop(token_len), 6) AS token_len_std, CAST(sum(token_len) AS BIGINT) AS token_len_sum, max(token_len) AS token_len_max, round(avg(word_len), 6) AS word_len_mean, round(stddev_pop(word_len), 6) AS word_len_std, CAST(sum(word_len) AS BIGINT) AS word_len_sum, max(word_len) AS word_len_max FROM plan GROUP BY batch_id")
def batch_stats(spark, d):
    plan, known = _static(spark, d)
    out = features.batch_statistics(plan, known, columns=("token_len", "word_len"))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith(("_mean", "_std"))})


@_query(f"WITH {STATIC}, m AS (SELECT batch_id, char_len, count(*) AS k FROM plan GROUP BY ALL), mode AS (SELECT batch_id, min(char_len) AS mode FROM m WHERE k = (SELECT max(k) FROM m x WHERE x.batch_id = m.batch_id) GROUP BY batch_id) SELECT batch_id, count(*) AS n, min(char_len) AS char_len_min, median(char_len) AS char_len_median, any_value(mode) AS char_len_mode FROM plan JOIN mode USING (batch_id) GROUP BY batch_id")
def batch_stats_experimental(spark, d):
    plan, known = _static(spark, d)
    counts = plan.join(known, "idx").groupBy("batch_id", "char_len").agg(F.count("*").alias("k"))
    mode = counts.groupBy("batch_id").agg(F.max_by("char_len", F.struct("k", -F.col("char_len"))).alias("char_len_mode"))
    return features.batch_statistics(plan, known, ("min", "median"), ("char_len",)).join(mode, "batch_id")


BASE_SQL = f"base AS (SELECT CAST({B} AS BIGINT) AS batch_size_x, avg(token_len) AS token_mean_x, CAST(sum(token_len) AS BIGINT) AS token_sum_x, max(token_len) AS token_max_x, avg(word_len) AS word_mean_x, CAST(sum(word_len) AS BIGINT) AS word_sum_x, max(word_len) AS word_max_x, CAST(sum(char_len) AS BIGINT) AS char_sum_x FROM ranked WHERE pos < {B})"
FEATURES_SQL = f"""{POS}, {BASE_SQL}, grid AS (SELECT CAST(unnest({GRID}) AS BIGINT) AS batch_size_y),
feat AS (SELECT p.pos, batch_size_y, avg(q.token_len) AS token_mean_y, stddev_pop(q.token_len) AS token_std_y, CAST(sum(q.token_len) AS BIGINT) AS token_sum_y, max(q.token_len) AS token_max_y, avg(q.word_len) AS word_mean_y, CAST(sum(q.word_len) AS BIGINT) AS word_sum_y, max(q.word_len) AS word_max_y, CAST(sum(q.char_len) AS BIGINT) AS char_sum_y
FROM ranked p CROSS JOIN grid JOIN ranked q ON q.pos >= p.pos AND q.pos < p.pos + batch_size_y GROUP BY p.pos, batch_size_y)"""


@_query(f"WITH {POS}, {BASE_SQL} SELECT * FROM base")
def baseline_features(spark, d):
    return features.baseline_features(_ranked(spark, d), B)


@_query(f"SELECT CAST(unnest({GRID}) AS BIGINT) AS size")
def candidate_grid(spark, d):
    return features.grid_frame(spark, B, RANGE)


@_query(f"WITH {FEATURES_SQL} SELECT pos, batch_size_y, round(token_mean_y, 6) AS token_mean_y, round(token_std_y, 4) AS token_std_y, token_sum_y, token_max_y, round(word_mean_y, 6) AS word_mean_y, word_sum_y, word_max_y, char_sum_y FROM feat")
def candidate_features(spark, d):
    out = features.candidate_features(_ranked(spark, d), GRID)
    return out.withColumns({"token_mean_y": F.round("token_mean_y", 6), "word_mean_y": F.round("word_mean_y", 6), "token_std_y": F.round("token_std_y", 4)})


@_query(f"WITH {FEATURES_SQL} SELECT pos, batch_size_y, " + ", ".join(f"CAST({r}_y AS DOUBLE) / {r}_x AS {r}_diff" for r in features.RATIOS) + " FROM feat CROSS JOIN base")
def ratio_features(spark, d):
    ranked = _ranked(spark, d)
    rows = features.ratio_features(features.candidate_features(ranked, GRID), features.baseline_features(ranked, B))
    return rows.select("pos", "batch_size_y", *(f"{r}_diff" for r in features.RATIOS))


@_query(f"WITH {_walk_cte()} SELECT CAST(pos AS BIGINT) AS pos, CAST(coalesce(max(CASE WHEN ratio <= {THRESHOLD} THEN c END), {B}) AS BIGINT) AS size FROM (SELECT p.pos, c, (coalesce(e.before, t.total) - p.before) / CAST(base.s AS DOUBLE) AS ratio FROM s p JOIN t ON t.k = p.k JOIN base ON base.k = p.k CROSS JOIN grid LEFT JOIN s e ON e.pos = p.pos + c) GROUP BY pos")
def optimal_size_by_position(spark, d):
    ranked = _ranked(spark, d)
    ratios = features.ratio_features(features.candidate_features(ranked, GRID), features.baseline_features(ranked, B))
    return features.optimal_sizes(ratios, B, THRESHOLD)


# The dynamic plan and its passes
def _sizes(spark, d, stage, **options):
    config = PlanConfig(batch_size=B, max_range=RANGE, threshold=THRESHOLD, **options)
    out = plan_sizes(_lens(spark, d).drop("text"), config)
    return out.where(F.col("stage") == stage).select("batch_id", "size")


@_query(f"WITH RECURSIVE {_walk_cte()} SELECT batch_id, size FROM walk")
def plan_dynamic_raw(spark, d):
    return _sizes(spark, d, "raw")


@_query(f"WITH RECURSIVE {_walk_cte('padded_area')} SELECT batch_id, size FROM walk")
def plan_dynamic_padded_area(spark, d):
    return _sizes(spark, d, "raw", pressure="padded_area")


@_query(f"WITH RECURSIVE {_walk_cte(part='lang')} SELECT k AS lang, batch_id, size FROM walk")
def plan_dynamic_by_lang(spark, d):
    config = PlanConfig(batch_size=B, max_range=RANGE, threshold=THRESHOLD)
    out = plan_sizes(_lens(spark, d, "lang").drop("text"), config, "lang")
    return out.where("stage = 'raw'").select(F.col("plan_key").alias("lang"), "batch_id", "size")


@_query(f"WITH RECURSIVE {SMOOTH} SELECT i AS batch_id, size FROM smooth")
def plan_smoothed(spark, d):
    return _sizes(spark, d, "smooth")


@_query(f"WITH RECURSIVE {EVENED} SELECT i AS batch_id, size FROM evened")
def plan_even(spark, d):
    return _sizes(spark, d, "final")


@_query(f"WITH RECURSIVE {FRIENDLY} SELECT i AS batch_id, size FROM friendly")
def plan_friendly(spark, d):
    return _sizes(spark, d, "final", friendly=True, even=False)


@_query(f"WITH RECURSIVE {FULL} SELECT i AS batch_id, size FROM full_plan")
def plan_dynamic_full(spark, d):
    return _sizes(spark, d, "final", friendly=True)


@_query(f"WITH RECURSIVE {EVENED}, spans AS (SELECT i, size, sum(size) OVER (ORDER BY i) - size AS p0 FROM evened) SELECT CAST(i AS BIGINT) AS batch_id, CAST(pos - p0 AS BIGINT) AS slot, idx FROM r JOIN spans ON pos >= p0 AND pos < p0 + size")
def plan_dynamic_rows(spark, d):
    config = PlanConfig(batch_size=B, max_range=RANGE, threshold=THRESHOLD)
    return dynamic_plan(_lens(spark, d).drop("text"), config).select("batch_id", "slot", "idx")


@_query("SELECT 0::BIGINT AS missing, 0::BIGINT AS repeated, 0::BIGINT AS oversize, 0::BIGINT AS gaps")
def plan_invariants(spark, d):
    known = _lens(spark, d).drop("text")
    config = PlanConfig(batch_size=B, max_range=RANGE, threshold=THRESHOLD)
    return plan_violations(dynamic_plan(known, config), known, CAP)


@_query(f"SELECT CAST(n AS BIGINT) AS n, {FRIENDLY_SQL.format('n')} AS friendly FROM range(1, 513) t(n)")
def friendly_sizes(spark, d):
    return spark.range(1, 513).select(F.col("id").alias("n"), friendly_floor_column(F.col("id")).alias("friendly"))


@_query("SELECT CAST(n AS BIGINT) AS n, CAST(CASE WHEN n = 1 THEN 1 ELSE n - n % 2 END AS BIGINT) AS even FROM range(1, 513) t(n)")
def even_sizes(spark, d):
    return spark.range(1, 513).select(F.col("id").alias("n"), even_floor_column(F.col("id")).cast("bigint").alias("even"))


@_query(f"WITH {STATIC} SELECT batch_id, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idx_sum, CASE WHEN batch_id < 3 THEN batch_id END AS pinned_at FROM plan GROUP BY batch_id")
def epoch_shuffle(spark, d):
    rows = epoch(_static(spark, d)[0], 0)
    return rows.groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("idx").alias("idx_sum"), F.max(F.when(F.col("batch_id") < 3, F.col("place"))).alias("pinned_at"))


# Collation, splitting, merging, fallback
def _tokens(spark, d):
    text = _lens(spark, d)
    ids = F.transform(F.split("text", r"[ \t\n\r\f]+"), lambda w: F.length(w).cast("bigint"))
    return text.select("idx", F.when(F.col("text") == "", F.array().cast("array<bigint>")).otherwise(ids).alias("ids"), "text")


@_query(f"WITH {STATIC} SELECT batch_id, count(*) AS n, max(token_len) AS width, CAST(sum(token_len) AS BIGINT) AS mask_sum FROM plan GROUP BY batch_id")
def collate_shape(spark, d):
    made = collate.collate(_static(spark, d)[0], _tokens(spark, d))
    total = F.aggregate(F.flatten("attention_mask"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return made.select("batch_id", F.size("input_ids").cast("bigint").alias("n"), F.size(F.col("input_ids")[0]).cast("bigint").alias("width"), total.alias("mask_sum"))


@_query(f"WITH {STATIC} SELECT batch_id, CAST(ceil(max(token_len) / 8.0) * 8 AS BIGINT) AS width FROM plan GROUP BY batch_id")
def collate_multiple_of_8(spark, d):
    made = collate.collate(_static(spark, d)[0], _tokens(spark, d), multiple_of=8)
    return made.select("batch_id", F.size(F.col("input_ids")[0]).cast("bigint").alias("width"))


@_query(f"WITH {STATIC} SELECT batch_id, slot // 5 AS chunk_id, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idx_sum FROM plan GROUP BY ALL")
def split_chunks(spark, d):
    return collate.split_plan(_static(spark, d)[0], 5).groupBy("batch_id", "chunk_id").agg(F.count("*").alias("n"), F.sum("idx").alias("idx_sum"))


@_query("WITH b AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), m AS (SELECT max(len(w)) AS width FROM b) SELECT item_id, CAST(width AS BIGINT) AS width, CAST(list_sum(list_transform(w, lambda x: length(x))) + 9 * (width - len(w)) AS BIGINT) AS total FROM b, m")
def merge_padded(spark, d):
    ids = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.transform(F.split("text", " "), lambda w: F.length(w).cast("bigint")).alias("ids"))
    merged = collate.merge_outputs([ids.where("item_id < 20"), ids.where("item_id >= 20")], 9)
    return merged.select("item_id", F.size("ids").cast("bigint").alias("width"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@_query(f"WITH {TOTALS} SELECT batch_id, n, n * token_max > 6000 AS did_fallback, CAST(CASE WHEN n * token_max > 6000 THEN ceil(n / 5.0) ELSE 1 END AS BIGINT) AS chunks FROM totals")
def fallback_simulation(spark, d):
    return collate.fallback_chunks(plans.batch_totals(*_static(spark, d)), 6000, 5)


# Training arithmetic
@_query(f"WITH {STATIC} SELECT count(*) AS rows, count(DISTINCT batch_id) AS batches, round(2e-5 * greatest(1, count(*) // 8) / greatest(1, count(DISTINCT batch_id)), 12) AS scaled FROM plan")
def lr_scale(spark, d):
    return training.rate_scale(_static(spark, d)[0], 8, 2e-5).withColumn("scaled", F.round("scaled", 12))


@_query(f"WITH {TOTALS} SELECT batch_id, round(n / 8.0, 6) AS accumulated, 1.0::DOUBLE AS alone FROM totals")
def loss_weights(spark, d):
    totals = plans.batch_totals(*_static(spark, d))
    return totals.select("batch_id", F.round(training.loss_weight(F.col("n"), 8, 4), 6).alias("accumulated"), training.loss_weight(F.col("n"), 8, 1).alias("alone"))


@_query(f"WITH {TOTALS} SELECT count(*) AS batches, CAST(ceil(sum(n) / 8.0) AS BIGINT) AS static_batches, CAST(greatest(1, floor(500 * count(*) / ceil(sum(n) / 8.0))) AS BIGINT) AS steps FROM totals")
def step_scale(spark, d):
    return training.step_scale(_static(spark, d)[0], 8, 500)


@_query(f"WITH {STATIC}, c AS (SELECT batch_id AS step, slot // 5 AS chunk, count(*) AS size, sum(token_len) / 100.0 AS loss, max(token_len) % 7 = 0 AS failed FROM plan GROUP BY ALL) SELECT step, round(coalesce(sum(CASE WHEN NOT failed THEN loss * size / 16.0 END), 0), 6) AS loss, CAST(count(*) FILTER (failed) + 1 AS BIGINT) AS failures FROM c GROUP BY step")
def split_retry_step(spark, d):
    plan, known = _static(spark, d)
    chunks = collate.split_plan(plan, 5).join(known, "idx").groupBy(F.col("batch_id").alias("step"), "chunk_id").agg(F.count("*").alias("size"), (F.sum("token_len") / 100.0).alias("loss"), (F.max("token_len") % 7 == 0).alias("failed"))
    return training.retry_step(chunks, "split_retry", 16, 4).withColumn("loss", F.round("loss", 6))


# The offline side
LOG_SQL = f"{STATIC}, log AS (SELECT 'f' || batch_id % 3 AS file, pos AS ordinal, CASE WHEN batch_id % 5 = 0 THEN 0 ELSE 4 END AS size, plan.token_len AS token_length, plan.word_len AS word_length, plan.char_len AS char_length FROM plan JOIN ranked USING (idx))"
GROUP_SQL = f"{LOG_SQL}, a AS (SELECT *, CASE WHEN size = lag(size) OVER (PARTITION BY file ORDER BY ordinal) THEN 0 ELSE 1 END AS new FROM log), b AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY ordinal) AS run FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY file, run ORDER BY ordinal) - 1 AS k FROM b), g AS (SELECT *, sum(CASE WHEN size > 0 AND k % size = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY ordinal) AS gr FROM c), grouped AS (SELECT file, ordinal, size, token_length, word_length, char_length, CASE WHEN size > 0 THEN file || '_' || CAST(gr - 1 AS VARCHAR) ELSE file || '_' || CAST(gr AS VARCHAR) || '_Failed' END AS batch_group FROM g)"


def _log(spark, d):
    rows = plans.fixed_batches(_ranked(spark, d), B)
    return rows.select(F.concat(F.lit("f"), (F.col("batch_id") % 3).cast("string")).alias("file"), F.col("pos").alias("ordinal"), F.when(F.col("batch_id") % 5 == 0, 0).otherwise(4).alias("size"), F.col("token_len").alias("token_length"), F.col("word_len").alias("word_length"), F.col("char_len").alias("char_length"))


@_query(f"WITH {GROUP_SQL} SELECT file, ordinal, batch_group FROM grouped")
def run_groups(spark, d):
    return offline.run_groups(_log(spark, d)).select("file", "ordinal", "batch_group")


FIRST_SQL = f"{GROUP_SQL}, flagged AS (SELECT *, size > 0 AND batch_group = file || '_0' AS is_first FROM grouped)"


def _stat_sql(c: str) -> str:
    return f"round(avg({c}_length), 6) AS {c}_mean_y, round(stddev_samp({c}_length), 4) AS {c}_std_y, CAST(sum({c}_length) AS BIGINT) AS {c}_sum_y, max({c}_length) AS {c}_max_y, min({c}_length) AS {c}_min_y, CAST(trunc(median({c}_length)) AS BIGINT) AS {c}_median_y"


STATISTICS = ("mean", "std", "sum", "max", "min", "median")


def _group_stats(spark, d):
    log = offline.run_groups(_log(spark, d))
    log = log.withColumn("is_first", (F.col("size") > 0) & (F.col("batch_group") == F.concat("file", F.lit("_0"))))
    return offline.group_statistics(log, stats=STATISTICS)


@_query(f"WITH {FIRST_SQL}, y AS (SELECT batch_group, {', '.join(_stat_sql(c) for c in ('token', 'word', 'char'))} FROM flagged GROUP BY batch_group), x AS (SELECT file, round(avg(token_length), 6) AS token_mean_x, CAST(sum(char_length) AS BIGINT) AS char_sum_x FROM flagged WHERE is_first GROUP BY file) SELECT file, ordinal, y.*, token_mean_x, char_sum_x FROM flagged JOIN y USING (batch_group) LEFT JOIN x USING (file)")
def group_window_stats(spark, d):
    out = _group_stats(spark, d)
    names = [f"{c}_{s}_y" for c in ("token", "word", "char") for s in STATISTICS]
    digits = {n: F.round(n, 4 if "_std_" in n else 6) for n in [*names, "token_mean_x"] if "_mean_" in n or "_std_" in n}
    return out.withColumns(digits).select("file", "ordinal", "batch_group", *names, "token_mean_x", "char_sum_x")


@_query(f"WITH {FIRST_SQL}, y AS (SELECT batch_group, sum(token_length) AS ty, sum(char_length) AS cy, stddev_samp(token_length) AS sy FROM flagged GROUP BY batch_group), x AS (SELECT file, sum(token_length) AS tx, sum(char_length) AS cx, stddev_samp(token_length) AS sx FROM flagged WHERE is_first GROUP BY file) SELECT ordinal, round(coalesce(ty / tx, 0), 6) AS token_sum_diff, round(coalesce(cy / cx, 0), 6) AS char_sum_diff, round(coalesce(sy / nullif(sx, 0), 0), 4) AS token_std_diff FROM flagged JOIN y USING (batch_group) LEFT JOIN x USING (file)")
def diff_features(spark, d):
    out = features.all_ratios(_group_stats(spark, d), ("token_sum", "char_sum", "token_std"))
    return out.select("ordinal", F.round("token_sum_diff", 6).alias("token_sum_diff"), F.round("char_sum_diff", 6).alias("char_sum_diff"), F.round("token_std_diff", 4).alias("token_std_diff"))


@_query(f"WITH {FIRST_SQL}, x AS (SELECT file, arg_min(word_length, ordinal) AS w, arg_min(char_length, ordinal) AS c FROM flagged WHERE is_first GROUP BY file) SELECT ordinal, CASE WHEN is_first THEN w ELSE word_length END AS word_length, CASE WHEN is_first THEN c ELSE char_length END AS char_length FROM flagged LEFT JOIN x USING (file)")
def first_group_lengths(spark, d):
    log = offline.run_groups(_log(spark, d))
    log = log.withColumn("is_first", (F.col("size") > 0) & (F.col("batch_group") == F.concat("file", F.lit("_0"))))
    return offline.first_group_lengths(log).select("ordinal", "word_length", "char_length")


@_query(f"WITH {LEN} SELECT lang, token_len, min(idx) AS idx FROM len GROUP BY ALL")
def dedup_first(spark, d):
    return offline.dedup_first(_lens(spark, d, "lang"), ["lang", "token_len"], "idx").select("lang", "token_len", "idx")


TARGET_SQL = f"{TOTALS}, target AS (SELECT batch_id, n, token_max, CAST(token_sum AS DOUBLE) / (SELECT token_sum FROM totals WHERE batch_id = 0) AS target FROM totals)"


def _target(spark, d):
    totals = plans.batch_totals(*_static(spark, d))
    first = totals.where("batch_id = 0").select(F.col("token_sum").alias("first"))
    return totals.join(F.broadcast(first)).select("batch_id", "n", "token_max", (F.col("token_sum").cast("double") / F.col("first")).alias("target"))


@_query(f"WITH {TARGET_SQL} SELECT batch_id, round(target, 6) AS target FROM target")
def target_ratio(spark, d):
    return _target(spark, d).select("batch_id", F.round("target", 6).alias("target"))


@_query(f"WITH {TARGET_SQL} SELECT batch_id, CASE " + " ".join(f"WHEN target >= {a} AND target < {b} THEN {w}::DOUBLE" for a, b, w in WEIGHTS) + " ELSE 1.0::DOUBLE END AS weight FROM target")
def range_weights(spark, d):
    return _target(spark, d).select("batch_id", offline.range_weight(F.col("target"), WEIGHTS).alias("weight"))


@_query(f"WITH {TARGET_SQL} SELECT CASE WHEN target <= 0.1 THEN 'low' WHEN target <= 0.5 THEN 'middle' WHEN target <= 1.0 THEN 'high' ELSE 'over' END AS bucket, count(*) AS n FROM target GROUP BY ALL")
def cut_buckets(spark, d):
    return _target(spark, d).groupBy(offline.cut(F.col("target"), [0.1, 0.5, 1.0], ["low", "middle", "high", "over"]).alias("bucket")).agg(F.count("*").alias("n"))


@_query()
def adaptive_histogram(spark, d):
    rows = _lens(spark, d).select((F.col("token_len") / 512.0).alias("v"))
    breaks = offline.adaptive_breaks(rows, "v", 150)
    return rows.groupBy(offline.cut(F.col("v"), breaks, [f"{b:g}" for b in breaks] + ["over"]).alias("bucket")).agg(F.count("*").alias("n"))


@_query("SELECT lang, source, count(*) AS n, CAST(floor(count(*) * 0.1) AS BIGINT) AS n_test FROM documents GROUP BY ALL")
def stratified_split(spark, d):
    out = offline.stratified_split(_docs(spark, d).select("doc_id", "lang", "source"), ["lang", "source"], "doc_id")
    return out.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test"))


PREDICTED_SQL = f"{TARGET_SQL}, pr AS (SELECT *, 2 * target AS y, 2 * target + (batch_id % 7 - 3) * 0.05 AS p FROM target)"


def _predicted(spark, d):
    return _target(spark, d).select("batch_id", (2 * F.col("target")).alias("y"), (2 * F.col("target") + (F.col("batch_id") % 7 - 3) * 0.05).alias("p"))


def _metric_sql(where: str) -> str:
    return f"WITH {PREDICTED_SQL} SELECT count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(y - p)), 6) AS mae, round(avg(abs((y - p) / y)), 6) AS mape, round(1 - count(*) FILTER (y > 1 AND p <= 1) / count(*), 6) AS safe FROM pr {where}"


def _rounded_metrics(frame):
    return frame.select("n", *(F.round(c, 6).alias(c) for c in ("rmse", "r2", "mae", "mape", "safe")))


@_query(_metric_sql(""))
def regression_metrics(spark, d):
    return _rounded_metrics(offline.regression_metrics(_predicted(spark, d), "y", "p"))


@_query(_metric_sql("WHERE y BETWEEN 0.8 AND 1.2"))
def critical_region_metrics(spark, d):
    return _rounded_metrics(offline.regression_metrics(_predicted(spark, d), "y", "p", (0.8, 1.2)))


@_query(f"WITH {PREDICTED_SQL} SELECT round(1 - count(*) FILTER (y > 1 AND p <= 1) / count(*), 6) AS safe FROM pr")
def oom_accuracy(spark, d):
    return offline.regression_metrics(_predicted(spark, d), "y", "p").select(F.round("safe", 6).alias("safe"))


@_query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'fr') AND n_chars > 0")
def filter_lang_isin(spark, d):
    return _docs(spark, d).where(F.col("lang").isin("de", "fr") & (F.col("n_chars") > 0)).select("doc_id", "lang", "source")


@_query("SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 1")
def most_frequent_lang(spark, d):
    return _docs(spark, d).groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(1)


@_query("SELECT item_id, md5('Translate this from English to German:' || chr(10) || 'English: ' || text || chr(10) || 'German:') AS prompt_md5 FROM benchmark")
def prompt_template(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.md5(offline.prompt(F.col("text"), "English", "German")).alias("prompt_md5"))


@_query("SELECT CAST(b AS BIGINT) AS start_batch, CAST(m AS BIGINT) AS max_input_length, e AS explore FROM unnest([8, 16, 32]) x(b), unnest([128, 512]) y(m), unnest([false, true]) z(e)")
def config_grid(spark, d):
    return offline.config_grid(spark, [8, 16, 32], [128, 512])


@_query("SELECT doc_id, lang FROM documents ORDER BY md5(concat('21:', doc_id)), doc_id LIMIT 100")
def sample_exact(spark, d):
    return plans.sample_rows(_docs(spark, d).select("doc_id", "lang"), 100)


@_query()
def augment_bands(spark, d):
    lines = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("line_no"), "text")
    return offline.augment(lines, [(5, 20, 10), (20, 60, 10), (60, 120, 5), (120, 250, 5), (250, 400, 3)])


@_query()
def gbt_fit_predict(spark, d):
    """The pressure model fitted on simulated memory of the static plan's batches; rows are its predictions."""
    log = offline.simulated_log(plans.batch_totals(*_static(spark, d)))
    first = log.where("batch_id = 0").select(F.col("gpu_memory_usage").alias("m"), F.col("token_sum").alias("s"), F.col("token_max").alias("t"))
    rows = log.join(F.broadcast(first)).select("batch_id", (F.col("token_sum") / F.col("s")).alias("token_sum_diff"), (F.col("token_max") / F.col("t")).alias("token_max_diff"), (F.col("gpu_memory_usage") / F.col("m")).alias("target")).cache()
    model = offline.fit_pressure(rows, ["token_sum_diff", "token_max_diff"], "target", depth=3, trees=5)
    return model.transform(rows).select("batch_id", "target", "predicted")


@_query(f"WITH {STATIC} SELECT batch_id, slot, idx FROM plan")
def plan_dispatch_static(spark, d):
    """The dispatcher with the dynamic plan switched off."""
    return plan(_lens(spark, d).drop("text"), batch_size=B, dynamic=False).select("batch_id", "slot", "idx")


# Smaller relational operators of planning and the offline side
@_query("SELECT doc_id, lang, n_chars, source FROM documents")
def sorted_columns(spark, d):
    rows = _docs(spark, d).drop("text")
    return rows.select(*sorted(rows.columns))


@_query("SELECT doc_id AS idx, lang AS language FROM documents")
def renamed_columns(spark, d):
    return _docs(spark, d).select("doc_id", "lang").withColumnsRenamed({"doc_id": "idx", "lang": "language"})


@_query("SELECT doc_id, lang, source FROM documents")
def struct_expansion(spark, d):
    return _docs(spark, d).select("doc_id", F.struct("lang", "source").alias("made")).select("doc_id", "made.*")


@_query(f"WITH {POS} SELECT pos, idx FROM ranked WHERE pos >= 100 AND pos < 150")
def positional_slice(spark, d):
    return plans.positional_slice(_ranked(spark, d), 100, 50).select("pos", "idx")


@_query("SELECT lang, source, doc_id FROM documents ORDER BY lang, source, doc_id")
def multi_key_sort(spark, d):
    return _docs(spark, d).select("lang", "source", "doc_id").orderBy("lang", "source", "doc_id")


@_query(f"WITH {POS} SELECT pos FROM ranked ORDER BY md5(concat('21:', pos)), pos LIMIT 100")
def sample_ordinals(spark, d):
    return plans.sample_ordinals(_ranked(spark, d), 100)


@_query(f"WITH {GROUP_SQL} SELECT batch_group, count(DISTINCT size) = 1 AS uniform FROM grouped GROUP BY batch_group")
def uniform_groups(spark, d):
    return offline.uniform_groups(offline.run_groups(_log(spark, d)), "batch_group", "size")


@_query(f"WITH {TARGET_SQL} SELECT count(*) FILTER (target <= 0.5) AS n_low, count(*) FILTER (target > 0.5) AS n_high, round(count(*) FILTER (target <= 0.5) / count(*), 6) AS share_low, round(count(*) FILTER (target > 0.5) / count(*), 6) AS share_high FROM target")
def threshold_shares(spark, d):
    out = offline.threshold_shares(_target(spark, d), "target", 0.5)
    return out.withColumns({c: F.round(c, 6) for c in ("share_low", "share_high")})


@_query(_ORACLES["padding_by_strategy"].replace("SELECT strategy, count(*) AS batches", ", a AS (SELECT strategy, sum(area) AS area FROM g GROUP BY strategy) SELECT strategy, round((SELECT area FROM a WHERE strategy = 'normal') / area, 6) AS speedup FROM a --"))
def speedup_ratio(spark, d):
    """Padded areas stand for seconds."""
    return offline.speedups(padding_by_strategy(spark, d), "normal", cost="area").withColumn("speedup", F.round("speedup", 6))


@_query(f"WITH {STATIC}, first AS (SELECT count(*) AS first_size, max(token_len) AS first_top, sum(token_len) AS first_sum, max(char_len) AS first_char FROM plan WHERE batch_id = 0), b AS (SELECT batch_id, count(*) AS size, max(token_len) AS top, sum(token_len) AS total, max(char_len) AS char FROM plan GROUP BY batch_id) SELECT batch_id FROM b, first WHERE size = first_size AND top = first_top AND total = first_sum AND char = first_char")
def true_first_batch(spark, d):
    plan, known = _static(spark, d)
    each = plan.join(known, "idx").groupBy("batch_id").agg(F.count("*").alias("size"), F.max("token_len").alias("top"), F.sum("token_len").alias("total"), F.max("char_len").alias("char"))
    first = each.where("batch_id = 0").select(*(F.col(c).alias(f"first_{c}") for c in ("size", "top", "total", "char")))
    return offline.true_first_batch(each.join(F.broadcast(first)), {c: f"first_{c}" for c in ("size", "top", "total", "char")}).select("batch_id")


@_query(f"WITH {LEN} SELECT idx, md5(concat('21:', idx))[1:4] < '199a' AS is_validation, token_len FROM len")
def train_validation_lengths(spark, d):
    """Both parts of a corpus with their lengths."""
    return offline.train_validation(_lens(spark, d).drop("text"), id_col="idx").select("idx", "is_validation", "token_len")


@_query(f"WITH {STATIC} SELECT batch_id, count(*) AS size FROM plan GROUP BY batch_id")
def batch_size_by_key(spark, d):
    return training.batch_size_by_key(collate.collate(_static(spark, d)[0], _tokens(spark, d)), "input_ids")


@_query(_ORACLES["lr_scale"])
def auto_lr_scale(spark, d):
    return training.auto_rate(_static(spark, d)[0], 8, 2e-5, True).withColumn("scaled", F.round("scaled", 12))


@_query(f"WITH {STATIC}, c AS (SELECT batch_id, slot // 5 AS chunk_id, count(*) AS size FROM plan GROUP BY ALL) SELECT batch_id, chunk_id, round(size / sum(size) OVER (PARTITION BY batch_id), 6) AS weight FROM c")
def loss_weights_in_fallback(spark, d):
    """Without accumulation a chunk's loss counts by its share of the batch."""
    chunks = collate.split_plan(_static(spark, d)[0], 5).groupBy("batch_id", "chunk_id").agg(F.count("*").alias("size"))
    whole = chunks.groupBy("batch_id").agg(F.sum("size").alias("total"))
    return chunks.join(whole, "batch_id").select("batch_id", "chunk_id", F.round(training.loss_weight(F.col("size"), 16, 1, F.col("total")), 6).alias("weight"))


@_query(f"WITH {STATIC} SELECT batch_id AS step, 0.0::DOUBLE AS loss, 1::BIGINT AS failures FROM plan GROUP BY batch_id HAVING max(token_len) % 7 = 0")
def skip_step(spark, d):
    """Only steps that failed are retried."""
    plan, known = _static(spark, d)
    steps = plan.join(known, "idx").groupBy(F.col("batch_id").alias("step")).agg(F.count("*").alias("size"), (F.sum("token_len") / 100.0).alias("loss"), (F.max("token_len") % 7 == 0).alias("failed"))
    return training.retry_step(steps.where("failed"), "skip", 16, 4)


@_query(f"WITH {STATIC} SELECT count(*) AS rows, true AS timed FROM plan")
def timed_consumer(spark, d):
    rows, seconds = collate.timed(_static(spark, d)[0])
    return spark.range(1).select(F.lit(rows).cast("bigint").alias("rows"), F.lit(seconds > 0).alias("timed"))


@_query("SELECT CAST(count(*) FILTER (list_max(w) >= 12) AS BIGINT) AS violations FROM (SELECT list_transform(string_split(text, ' '), lambda x: length(x)) AS w FROM benchmark)")
def id_violations(spark, d):
    ids = spark.read.parquet(f"{d}/benchmark.parquet").select(F.transform(F.split("text", " "), lambda w: F.length(w).cast("bigint")).alias("ids"))
    return lengths.id_violations(ids, "ids", 12).toDF("violations").select(F.col("violations").cast("bigint"))


@_query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.0::DOUBLE ELSE n_chars::DOUBLE END AS x FROM documents")
def clean_numbers(spark, d):
    """Every third number is made a NaN, a null or an infinity, and cleaned."""
    odd = F.when(F.col("doc_id") % 9 == 0, F.lit(float("nan"))).when(F.col("doc_id") % 9 == 3, F.lit(None)).otherwise(F.lit(float("inf")))
    rows = _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, odd).otherwise(F.col("n_chars").cast("double")).alias("x"))
    return offline.clean_numbers(rows, ("x",))


flagship = padding_by_strategy


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
