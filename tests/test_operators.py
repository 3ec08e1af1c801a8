import numpy as np
import pytest
from pyspark.sql import functions as F

from batchplan.operators import collate, features, lengths, offline, plans, training
from batchplan.operators.dynamic import PlanConfig, dynamic_plan, epoch, plan, plan_violations
from batchplan.sources import files
from batchplan.streaming.micro import length_profile, plan_stream


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def by_idx(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("idx").collect()]


def test_lengths(spark):
    docs = frame(spark, ["alpha beta gamma", "delta epsilon zeta", "你好 世界 再见", None, "", "  a  b", "one"])
    whole = lengths.whitespace_lengths(docs, 2)
    assert by_idx(whole, "token_len", "word_len", "char_len", "text") == [(2, 2, 10, "alpha beta"), (2, 2, 13, "delta epsilon"), (2, 2, 5, "你好 世界"), (0, 0, 0, ""), (0, 0, 0, ""), (2, 2, 6, "  a  b"), (1, 1, 3, "one")]
    decoded = lengths.whitespace_lengths(docs.where("doc_id < 3"), 4, special_tokens=2, strategy="decode")
    assert by_idx(decoded, "token_len", "word_len", "char_len") == [(4, 2, 11), (4, 2, 14), (4, 2, 6)]
    with pytest.raises(ValueError):
        lengths.whitespace_lengths(docs, 4, strategy="other")


def test_tokenizer_lengths(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({"a": 0, "b": 1, "<unk>": 2}, unk_token="<unk>"))
    tok.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    tok.save(str(tmp_path / "t.json"))
    docs = frame(spark, ["a b  a", "b", None])
    assert by_idx(lengths.tokenizer_lengths(docs, str(tmp_path / "t.json"), 2), "token_len", "char_len", "text") == [(2, 3, "a b"), (1, 1, "b"), (0, 0, "")]
    assert by_idx(lengths.tokenizer_lengths(docs, str(tmp_path / "t.json"), 2, strategy="decode"), "char_len") == [(5,), (1,), (0,)]


def test_precomputed(spark):
    docs = frame(spark, ["x y z", "x"])
    known = spark.createDataFrame([(0, 3, 3, 8), (1, 1, 1, 2)], "idx long, token_len long, word_len long, char_len long")
    assert by_idx(lengths.precomputed_lengths(docs, known), "token_len", "text") == [(3, "x y z"), (1, "x")]
    with pytest.raises(ValueError):
        lengths.precomputed_lengths(docs, known.limit(1))
    with pytest.raises(ValueError):
        lengths.precomputed_lengths(docs, known.drop("word_len"))
    ids = spark.createDataFrame([([0, 4],), ([5],), ([-1],)], "ids array<int>")
    assert lengths.id_violations(ids, "ids", 5).first().n_bad == 2


def known(spark, token):
    return spark.createDataFrame([(k, t, t, 5 * t) for k, t in enumerate(token)], "idx long, token_len long, word_len long, char_len long")


def test_positions_in_stripes(spark):
    token = [int(x) for x in np.random.default_rng(1).integers(0, 5, 200)]
    rows = plans.positions(known(spark, token), stripe=7).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(200))
    assert [r.idx for r in rows] == sorted(range(200), key=lambda k: (-token[k], k))


def test_candidate_features_across_blocks(spark):
    token = sorted(np.random.default_rng(2).integers(1, 90, 9000).tolist(), reverse=True)
    ranked = plans.positions(known(spark, token))
    rows = features.candidate_features(ranked, [2, 5, 8], 450).collect()
    assert len(rows) == 60
    for r in rows:
        part = np.array(token[r.pos : r.pos + r.batch_size_y])
        assert r.token_sum_y == part.sum() and r.token_max_y == part.max() and abs(r.token_std_y - part.std()) < 1e-4 and abs(r.token_mean_y - part.mean()) < 1e-9
    small = features.ratio_features(features.candidate_features(plans.positions(known(spark, [20, 18, 16, 14, 12, 10, 8])), [2, 3, 8]), features.baseline_features(plans.positions(known(spark, [20, 18, 16, 14, 12, 10, 8])), 2))
    assert {r.size for r in features.optimal_sizes(small, 2, -1.0, "constant:0").collect()} == {2}
    assert {r.size for r in features.optimal_sizes(small, 2, 0.9, "constant:0").collect()} == {8}
    with pytest.raises(ValueError):
        features.pressure("other")


def test_dynamic_plan(spark):
    token = [int(x) for x in np.random.default_rng(3).integers(1, 60, 300)]
    rows = known(spark, token).withColumn("lang", F.when(F.col("idx") % 3 == 0, "a").otherwise("b"))
    made = plan(rows, batch_size=8)
    assert plan_violations(made, rows, 16).first().asDict() == {"missing": 0, "repeated": 0, "oversize": 0, "gaps": 0}
    keyed = dynamic_plan(rows, PlanConfig(batch_size=8), "lang").collect()
    assert {(r.plan_key, r.idx % 3 == 0) for r in keyed} == {("a", True), ("b", False)} and len(keyed) == 300
    assert plan(rows.limit(0)).collect() == []
    with pytest.raises(ValueError):
        PlanConfig(batch_size=0)


def test_epochs(spark):
    made = plans.static_plan(known(spark, list(range(50))), 8)
    zero, again, one = (sorted(map(tuple, epoch(made, n, keep_first=3).collect())) for n in (0, 0, 1))
    assert zero == again and [r[2:] for r in zero] != [r[2:] for r in one]
    assert {r[2]: r[1] for r in zero if r[2] < 3} == {0: 0, 1: 1, 2: 2}
    member = {r.idx: r.batch_id for r in made.collect()}
    assert all(member[r[4]] == r[2] for r in zero + one) and sorted(r[4] for r in one) == list(range(50))


def test_collate_split_merge(spark):
    tokens = spark.createDataFrame([(0, [1, 2, 3], "x"), (1, [4], "y"), (2, [5, 6], "z")], "idx long, ids array<bigint>, text string")
    made = plans.fixed_batches(tokens.withColumn("pos", F.col("idx")), 2).select("batch_id", "slot", "idx")
    got = {r.batch_id: r for r in collate.collate(made, tokens).collect()}
    assert got[0].input_ids == [[1, 2, 3], [4, 0, 0]] and got[0].attention_mask == [[1, 1, 1], [1, 0, 0]] and got[1].texts == ["z"]
    wide = collate.collate(made, tokens, pad=9, multiple_of=8).first()
    assert {len(x) for x in wide.input_ids} == {8}
    assert [len(c["input_ids"]) for c in collate.split_batch({"input_ids": list(range(7)), "texts": list("abcdefg")}, 3)] == [3, 3, 1]
    parts = collate.split_inputs({"input_ids": [1, 2, 3], "labels": [4, 5, 6], "scale": 2.0, "name": "abc", "other": [1]}, 2)
    assert parts == [{"input_ids": [1, 2], "labels": [4, 5], "scale": 2.0, "name": "abc", "other": [1]}, {"input_ids": [3], "labels": [6], "scale": 2.0, "name": "abc", "other": [1]}]
    for bad, error in ((lambda: collate.split_inputs({"input_ids": [1]}, 0), ValueError), (lambda: collate.split_inputs({}, 1), KeyError), (lambda: collate.split_batch({"input_ids": []}, 0), ValueError)):
        with pytest.raises(error):
            bad()
    merged = collate.merge_outputs([tokens.where("idx = 0"), tokens.where("idx > 0")], 9)
    assert {r.idx: r.ids for r in merged.collect()} == {0: [1, 2, 3], 1: [4, 9, 9], 2: [5, 6, 9]}
    assert collate.merge_outputs([], 9) is None
    assert collate.resolve_pad(None, 0, 3) == 0
    with pytest.raises(ValueError):
        collate.resolve_pad(None)
    assert [r.batch_id for r in collate.stream_batches(collate.collate(made, tokens))] == [0, 1]


def test_fallback(spark):
    made = plans.static_plan(known(spark, [9, 9, 9, 9, 1, 1, 1, 1]), 4).join(known(spark, [9, 9, 9, 9, 1, 1, 1, 1]), "idx")

    def work(rows):
        if len(rows) * rows.token_len.max() > 20:
            raise MemoryError
        return rows[["idx"]].assign(size=len(rows))

    got = {r.idx: (r.size, r.did_fallback) for r in collate.run_batches(made, work, "idx long, size long", smallest=2).collect()}
    assert got == {k: (2, True) if k < 4 else (4, False) for k in range(8)}
    with pytest.raises(Exception, match="MemoryError"):
        collate.run_batches(made, work, "idx long, size long", smallest=3).collect()


def test_training(spark):
    assert training.scaled_rate(2e-5, 80, 8, 5) == pytest.approx(4e-5)
    with pytest.raises(ValueError):
        training.scaled_rate(1.0, 1, 0, 1)
    chunks = spark.createDataFrame([(0, 2, 1.5, False), (0, 2, 3.5, False), (1, 2, 1.5, True), (1, 2, 3.5, False), (2, 2, 1.0, True)], "step long, size long, loss double, failed boolean")
    got = {r.step: (r.loss, r.failures) for r in training.retry_step(chunks, "split_retry", 4, 1).collect()}
    assert got == {0: (2.5, 1), 1: (1.75, 2), 2: (0.0, 2)}
    assert {r.loss for r in training.retry_step(chunks, "skip", 4, 1).collect()} == {0.0}
    assert spark.range(1).select(training.loss_weight(F.lit(4), 8, 4) * 2.0).first()[0] == 1.0
    with pytest.raises(ValueError):
        training.retry_step(chunks, "other", 4, 1)
    with pytest.raises(MemoryError):
        training.retry_step(chunks, None, 4, 1)
    assert (training.smallest_chunk(None, 3), training.smallest_chunk(0, None), training.smallest_chunk(2, 9)) == (3, 1, 2)


def test_offline(spark):
    sizes = [2, 2, 2, 2, 0, 3, 3, 3, 0, 0]
    log = spark.createDataFrame([("f", k, s) for k, s in enumerate(sizes)], "file string, ordinal long, size long")
    assert [r.batch_group for r in offline.run_groups(log).orderBy("ordinal").collect()] == ["f_0", "f_0", "f_1", "f_1", "f_2_Failed", "f_2", "f_2", "f_2", "f_3_Failed", "f_3_Failed"]
    odd = spark.createDataFrame([(None, float("nan"), float("inf"), None)], "a int, b double, c double, d string")
    assert tuple(offline.clean_numbers(odd, ("c",)).first()) == (0, 0.0, 0.0, None)
    with pytest.raises(ValueError):
        offline.check_numbers(odd, ("a", "b"))
    offline.check_numbers(offline.clean_numbers(odd, ("c",)), ("a", "b", "c"))
    values = spark.createDataFrame([(v / 1000,) for v in range(1000)] + [(0.5,)] * 50, "v double")
    breaks = offline.adaptive_breaks(values, "v", 200)
    held = values.groupBy(offline.cut(F.col("v"), breaks, [str(b) for b in breaks] + ["over"])).count().collect()
    assert max(r["count"] for r in held) < 200 and sum(r["count"] for r in held) == 1050
    assert offline.adaptive_breaks(values.limit(0), "v") == [] and offline.adaptive_breaks(spark.createDataFrame([(1.0,)] * 3000, "v double"), "v")
    lines = spark.createDataFrame([(0, "a b"), (1, " "), (2, "c d e"), (3, "f")], "line_no long, text string")
    for r in offline.augment(lines, [(4, 6, 5), (1, 1, 2)]).collect():
        assert len(r.text.split()) in ((4, 5, 6) if r.band == 0 else (1,))
    assert offline.augment(lines.limit(0), [(1, 2, 1)]).collect() == []
    assert offline.replay({"old": log, "new": log}).groupBy("run").count().count() == 2


def test_model_round_trip(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rows = spark.createDataFrame([(x / 10, x / 5, 1.0) for x in range(60)], "token_sum_diff double, target double, w double")
    model = offline.fit_pressure(rows, ["token_sum_diff"], "target", weight="w", depth=3, trees=5)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.transform(rows).select("predicted").collect() == model.transform(rows).select("predicted").collect()
    assert offline.regression_metrics(model.transform(rows), "target", "predicted").first().r2 > 0.8


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text(" first \n\n   \nsecond\n")
    assert [tuple(r) for r in files.lines(spark, str(tmp_path / "t")).orderBy("line_no").collect()] == [(0, "first"), (1, "second")]
    assert [tuple(r) for r in files.texts(spark, ["x", "y"]).collect()] == [(0, "x"), (1, "y")]
    log = spark.createDataFrame([("m", 4, 128, 1.0), ("m", 8, 128, 2.0)], "model_name string, start_batch int, max_input_length int, gpu_memory_usage double")
    for _ in range(2):
        files.write_log(log, str(tmp_path / "log"))
    back = files.measurement_logs(spark, str(tmp_path / "log"))
    assert back.count() == 2 and back.select("file").distinct().count() >= 1
    assert plans.sample_rows(frame(spark, ["x"] * 30), 7).count() == 7
    assert len(files.LOG) == 15


def test_streams(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).repartition(3)
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    query = plan_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), PlanConfig(batch_size=4), ready=seen.append)
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 60 and got.select("epoch").distinct().count() == len(seen) == 3
    timed = stream.withColumn("at", F.timestamp_seconds(F.col("doc_id")))
    q = length_profile(timed, "at", "text").writeStream.format("memory").queryName("profile").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from profile").first()[0] == 60


def test_adaptive_breaks_leave_no_splittable_bucket(spark):
    """Neither a number of rounds nor one hot value ends the halving."""
    rng = np.random.default_rng(5)
    smooth, hot = rng.normal(0.5, 0.1, 20_000).tolist(), [1.5] * 5000
    breaks = offline.adaptive_breaks(spark.createDataFrame([(v,) for v in smooth + hot], "v double"), "v", 100)
    held = {}
    for v in smooth + hot:
        held.setdefault(int(np.searchsorted(breaks, v)), []).append(v)
    assert len(breaks) > 200 and all(len(h) < 100 or set(h) == {1.5} for h in held.values())


@pytest.mark.parametrize("stripe", [1, 7, 1 << 16])
def test_positions_of_hashed_ids(spark, stripe):
    """Ids far apart, below 0 and in no order; many stripes, and a frequent length spread over them."""
    import random

    from batchplan.operators.plans import positions

    rng = random.Random(9)
    rows = [(rng.randrange(-(1 << 63), 1 << 63), rng.choice([3, 3, 3, 9, 5])) for _ in range(300)]
    got = positions(spark.createDataFrame(rows, "idx bigint, token_len int"), stripe=stripe).collect()
    assert [(r.idx, r.token_len) for r in sorted(got, key=lambda r: r.pos)] == sorted(rows, key=lambda r: (-r[1], r[0])) and sorted(r.pos for r in got) == list(range(300))
    assert positions(spark.createDataFrame([], "idx bigint, token_len int"), stripe=stripe).collect() == []


def test_logs_of_several_configurations(spark, tmp_path):
    from batchplan.sources.files import write_log

    schema, place = "texts string, model_name string, start_batch int, max_input_length int", str(tmp_path / "log")
    write_log(spark.createDataFrame([("a", "m", 8, 512)], schema), place)
    write_log(spark.createDataFrame([("again", "m", 8, 512), ("b", "m", 16, 512), ("c", "n", 8, 512)], schema), place)
    assert sorted(r.texts for r in spark.read.parquet(place).collect()) == ["a", "b", "c"]
