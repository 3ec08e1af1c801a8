"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model is over UTF-8 bytes (A-Z lower-cased) of order 5: an n-gram is the low bytes of one 64-bit number, so histories and
suffixes are shifts and masks, and every count table is a frame sharded by that number. It is trained on trusted documents.

Scoring never sends the model to the text. Documents lie in blocks of neighbouring rows; a block asks for its distinct
n-grams. All orders from 3 up share the two bytes before the last one, so these say to which shard an n-gram goes, and there
it meets the probabilities and back-offs of every such order at once; the orders below have at most 256 * 257 rows. The
answers go back to their blocks and stand there before the text, which streams past them. What is exchanged follows the
blocks' distinct n-grams and one compressed copy of the text; a task holds one shard of the model or one block's answers.

A document is rejected if its perplexity is over its language's threshold, a quantile over trusted documents of that language. It
is the highest of three estimates: of those that the model was not trained on the empirical one and, as that of few documents is too low, the
log-normal bound under which that share of clean documents lies with a given confidence (a one-sided tolerance limit, which for many documents is the quantile
itself); and the empirical one of the other trusted documents. A short document's perplexity is an uncertain figure, so what counts is the
evidence, its length times the excess of its log-perplexity, which has to reach a least one. Text of one word over and over is cheap for any n-gram model, so
a document is also rejected if its words repeat the word before them more often than trusted text of its language does: by
the log-likelihood ratio of the document's own rate to the trusted rate, over the same quantile and the same least evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchplan.llm.spark_io import freeing, settled, written

ORDER = 5
_SYMBOLS = 256
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shards of the model, and bytes of a text that are looked at together.
SHARDS, CHUNK = 1024, 1 << 22
#: Rows, of a bit for each of 64 neighbouring documents, that are sent to every task to find the trusted ones; beyond it their texts are shuffled.
MOST_MARKS = 1_000_000


@dataclass(frozen=True)
class Quality:
    """quantile: of trusted documents, the threshold of a language; confidence: that this share of clean documents lies under the log-normal estimate; held_out: one in so many trusted documents is kept from training, for the
    thresholds; least: held-out documents that a language needs for a threshold of its own, with fewer it gets that of all;
    block: bytes of text in a block, on average;
    evidence: least log-likelihood ratio, in nats, at which a perplexity over the threshold or repeated words reject (14: once in a million)."""

    quantile: float = 0.99
    confidence: float = 0.95
    evidence: float = 14.0
    held_out: int = 5
    least: int = 10
    block: int = 16_000_000


def _is_held_out(i: Column, options: Quality) -> Column:
    return F.pmod(F.xxhash64(F.lit("held out"), i), F.lit(options.held_out)) == 0


def lowered(text: str) -> bytes:
    return text.encode().translate(_LOWER)


def grams(low: bytes) -> Iterator[np.ndarray]:
    """The n-grams that end at each byte of a lowered text, and at the zero byte that closes it, in stretches; before the text stand zero bytes."""
    padded = bytes(ORDER - 1) + low + b"\0"
    for at in range(0, len(low) + 1, CHUNK):
        b = np.frombuffer(padded[at : at + CHUNK + ORDER - 1], np.uint8).astype(np.int64)
        n = len(b) - ORDER + 1
        g = b[:n].copy()
        for k in range(1, ORDER):
            g <<= 8
            g |= b[k : k + n]
        yield g


def repeats(text: str) -> tuple[int, int]:
    """How many words, lower-cased and cut at white space, equal the word before, and how many have one before."""
    w = text.lower().split()
    return sum(map(str.__eq__, w, w[1:])), max(0, len(w) - 1)


def _excess(k: Column, n: Column, rate: Column) -> Column:
    """Log-likelihood ratio of k repeats in n places to the rate, 0 if they are not more frequent."""
    own = k / F.nullif(n, F.lit(0))
    others = F.when(k < n, (n - k) * F.log((1 - own) / (1 - rate))).otherwise(0.0)
    return F.when(rate.isNotNull(), F.when(own > rate, k * F.log(own / rate) + others).otherwise(0.0))


def _suffix(g: Column | str, m: int) -> Column:
    return F.col(g).bitwiseAND(F.lit((1 << 8 * m) - 1)) if isinstance(g, str) else g.bitwiseAND(F.lit((1 << 8 * m) - 1))


def _in_blocks(docs: DataFrame, limit: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, lang, text, block, at): stretches of neighbouring rows of the files, the same for every way of splitting them. at: the place in the stretch. What is no scan of files is written first."""
    columns = [F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")]
    try:
        docs.select(*columns, "_metadata.row_index")
    except AnalysisException:
        docs, columns = written(docs.select(*columns)), ["id", "lang", "text"]
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(columns[2])), F.lit(0)).alias("bytes")).first()
    each = max(1, int(limit * size.n / max(1, size.bytes)))
    return docs.select(*columns, F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / each)).alias("block"), F.pmod(F.col("_metadata.row_index"), F.lit(each)).alias("at"))


def _of_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the rows with one of the ids. Ids meet without texts, and what goes to the texts is a bit for each row, so no number of ids is too large."""
    word, bit = F.floor(F.col("at") / 64).alias("word"), F.pmod("at", F.lit(64)).cast("int")
    marks = rows.select("id", "block", "at").join(ids, "id", "left_semi").groupBy("block", word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    marks = settled(marks.select(F.col("block").alias("b"), F.col("word").alias("w"), "bits"))
    marked = F.call_function("getbit", F.col("bits"), bit) == 1
    sent = F.broadcast(marks) if marks.count() <= MOST_MARKS else marks
    return rows.where("length(text) > 0").join(sent, (F.col("block") == F.col("b")) & (word == F.col("w")) & marked, "left_semi").select("text")


def _shard(middle):
    """The shard of the two bytes before the last one; of a NumPy array or of a column."""
    if isinstance(middle, Column):
        return F.shiftright((middle.bitwiseAND(F.lit(0xFFFF)) * F.lit(2654435769)).bitwiseAND(F.lit(0xFFFFFFFF)), 22).cast("int")
    return (((middle & 0xFFFF) * 2654435769) & 0xFFFFFFFF) >> 22


def _packed(g: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences, like bytes side by side; empty for none."""
    steps = np.diff(g, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T
    return pa.compress(steps.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    steps = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n).T
    return np.cumsum(np.ascontiguousarray(steps).view(np.int64).ravel())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, n) over the texts of a task, merged while they are few."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def out():
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000]), pa.array(counts[at : at + 100_000])], names=["g", "n"])

    for b in batches:
        for text in b.column(0):
            for g in grams(lowered(text.as_py())):
                own, n = np.unique(g, return_counts=True)
                at = np.searchsorted(keys, own)
                old = at < len(keys)
                old[old] = keys[at[old]] == own[old]
                counts[at[old]] += n[old]
                if not old.all():
                    keys, first = np.concatenate((keys, own[~old])), np.concatenate((counts, n[~old]))
                    order = np.argsort(keys, kind="stable")
                    keys, counts = keys[order], first[order]
            if len(keys) > 1_000_000:
                yield from out()
                keys, counts = keys[:0], counts[:0]
    yield from out()


ROW = "shard int, kind int, g long, v double, block long, n int, grams binary"
ANSWER = "block long, kind int, n int, grams binary, logp binary"
ASKED = 100  # the kind of rows that ask; they stand behind those of the model


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's distinct n-grams, a row for each shard."""

    def out(block: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        g = np.unique(np.concatenate(parts))
        shard = _shard(g >> 8)
        order = np.argsort(shard, kind="stable")
        g, shard = g[order], shard[order]
        starts = np.flatnonzero(np.diff(shard, prepend=-1))
        sizes = np.diff(np.append(starts, len(g)))
        k = len(starts)
        return pa.RecordBatch.from_arrays(
            [pa.array(shard[starts], pa.int32()), pa.array([ASKED] * k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.array([block] * k, pa.int64()), pa.array(sizes, pa.int32()), pa.array([_packed(p) for p in np.split(g, starts[1:])], pa.binary())],
            names=[c.split()[0] for c in ROW.split(", ")],
        )

    last, parts, held = None, [], 0
    for b in batches:
        for block, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if block != last and parts:
                yield out(last, parts)
                parts, held = [], 0
            last, text = block, text.as_py()
            for g in grams(lowered(text)) if text else ():
                parts.append(g)
                held += len(g)
                if held > 2_000_000:
                    parts = [np.unique(np.concatenate(parts))]
                    held = 0
    if parts:
        yield out(last, parts)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Of n-grams seen once, twice, and more, from how many n-grams have a count of 1 to 4; where the estimate fails or is not above 0, 1/2, 1 and 3/2, so that every history leaves something to unseen bytes."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    found = [k - (k + 1) * y * b / a if a and b else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(d, float(k)) if y and d > 0 else k / 2 for k, d in zip((1, 2, 3), found, strict=True))


def fit(counts: DataFrame) -> tuple[list[DataFrame], list[DataFrame], float]:
    """From (g, c) of the highest order: for each order from 1 the frames (g, p) and (h, b), and the back-off of order 1.

    Lower orders count the distinct bytes before an n-gram. p is the interpolated probability of the last byte after the history, b
    the share that the history leaves to the next lower order; the order below 1 is uniform. Nothing to train on gives empty frames.
    """
    tables = [settled(counts)]
    for m in range(ORDER - 1, 0, -1):
        tables.insert(0, settled(tables[0].groupBy(_suffix("g", m).alias("g")).agg(F.count("*").alias("c"))))
    of = reduce(DataFrame.unionByName, [t.groupBy(F.lit(m).alias("m")).agg(*(F.count_if(F.col("c") == k).alias(f"n{k}") for k in range(1, 5))) for m, t in enumerate(tables, 1)])
    stats = {r.m: [r.n1, r.n2, r.n3, r.n4] for r in of.collect()}  # a row for each order
    probabilities: list[DataFrame] = []
    backoffs: list[DataFrame] = []
    lowest = 1.0
    for m, table in enumerate(tables, 1):
        d1, d2, d3 = _discounts(stats.get(m, [0, 0, 0, 0]))
        taken = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = table.select("g", F.shiftright("g", 8).alias("h"), "c", F.least(taken, F.col("c").cast("double")).alias("d"))
        sums = rows.groupBy("h").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("b"))
        if m == 1:
            first = sums.first()
            lowest = first.b if first else 1.0
            below = F.lit(1.0 / _SYMBOLS)
        else:
            rows = rows.withColumn("s", _suffix("g", m - 1)).join(probabilities[-1].select(F.col("g").alias("s"), F.col("p").alias("low")), "s")
            below = F.col("low")
        probabilities.append(settled(rows.join(sums, "h").select("g", ((F.col("c") - F.col("d")) / F.col("total") + F.col("b") * below).alias("p"))))
        backoffs.append(sums.select("h", "b"))
    return probabilities, backoffs, lowest


def _found(keys: np.ndarray, values: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of g stand among the sorted keys, and their values (0 for others)."""
    if not len(keys):
        return np.zeros(len(g), bool), np.zeros(len(g))
    at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
    hit = keys[at] == g
    return hit, np.where(hit, values[at], 0.0)


def _answered(asked: DataFrame, model: tuple[list[DataFrame], list[DataFrame], float]) -> DataFrame:
    """What the blocks asked for with its log-probabilities, by a join with the shards of all orders from 3 up."""
    probabilities, backoffs, lowest = model
    few = {}  # orders 1 and 2: at most 256 + 256 * 256 probabilities and 256 back-offs
    for name, frame, key in (("p1", probabilities[0], "g"), ("p2", probabilities[1], "g"), ("b2", backoffs[1], "h")):
        rows = sorted(frame.collect())
        few[name] = (np.array([r[key] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64))
    bound = asked.sparkSession.sparkContext.broadcast((few, lowest))
    none = [F.lit(None).cast(t) for t in ("long", "int", "binary")]
    names = [c.split()[0] for c in ROW.split(", ")]
    rows = asked
    for m in range(3, ORDER + 1):
        for kind, frame, key, shift in ((2 * m, probabilities[m - 1], "g", 8), (2 * m + 1, backoffs[m - 1], "h", 0)):
            value = frame.columns[1]
            rows = rows.unionByName(frame.select(_shard(F.shiftright(key, shift)).alias("shard"), F.lit(kind).alias("kind"), F.col(key).alias("g"), F.col(value).alias("v"), *none).toDF(*names))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few, lowest = bound.value
        shard, model = None, {}
        empty = (np.empty(0, np.int64), np.empty(0))

        def logp(g: np.ndarray) -> np.ndarray:
            p = np.full(len(g), 1.0 / _SYMBOLS)
            for m in range(1, ORDER + 1):
                s = g & ((1 << 8 * m) - 1)
                hit, own = _found(*(few[f"p{m}"] if m < 3 else model.get(2 * m, empty)), s)
                if m == 1:
                    back = np.full(len(g), lowest)
                else:
                    seen, b = _found(*(few["b2"] if m == 2 else model.get(2 * m + 1, empty)), s >> 8)
                    back = np.where(seen, b, 1.0)
                p = np.where(hit, own, back * p)
            return np.log(p).astype("<f4")

        for batch in batches:
            shards, kinds = (batch.column(k).to_numpy() for k in (0, 1))
            cuts = np.flatnonzero(np.concatenate(([True], (np.diff(shards) != 0) | (np.diff(kinds) != 0)))) if len(shards) else ()
            out = []
            for first, end in zip(cuts, np.append(cuts[1:], len(shards)), strict=True) if len(cuts) else ():
                part = batch.slice(first, end - first)
                if shards[first] != shard:
                    shard, model = shards[first], {}
                kind = int(kinds[first])
                if kind != ASKED:
                    g, v = part.column(2).to_numpy(), part.column(3).to_numpy()
                    old = model.get(kind, empty)
                    model[kind] = (np.concatenate((old[0], g)), np.concatenate((old[1], v)))
                    continue
                for block, n, data in zip(*(part.column(k).to_pylist() for k in (4, 5, 6)), strict=True):
                    out.append((block, 0, n, data, logp(_unpacked(data, n)).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=[c.split()[0] for c in ANSWER.split(", ")])

    return rows.repartition("shard").sortWithinPartitions("shard", "kind", "g").mapInArrow(freeing(answer), ANSWER)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of rows of one block, some megabytes each and compressed: id, lang, the lowered text, repeated words."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))
    for b in batches:
        blocks, texts = b.column(3).to_pylist(), b.column(2).to_pylist()
        first = size = 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if size > CHUNK or k + 1 == len(texts) or blocks[k + 1] != blocks[k]:
                own = texts[first : k + 1]
                same = [repeats(t) if t else (0, 0) for t in own]
                part = pa.record_batch([b.column(0).slice(first, len(own)), b.column(1).slice(first, len(own)), pa.array([lowered(t) if t else None for t in own], pa.large_binary()), *(pa.array([s[j] for s in same], pa.int64()) for j in (0, 1))], names=["id", "lang", "low", "n_repeats", "n_pairs"])
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, part.schema, options=options) as w:
                    w.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([blocks[k]], pa.int64()), pa.array([1], pa.int32()), pa.nulls(1, pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary()), pa.nulls(1, pa.binary())], names=[c.split()[0] for c in ANSWER.split(", ")])
                first, size = k + 1, 0


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (block, kind): a block's answers are held while its texts pass."""
    block, parts, table = None, [], None
    for b in batches:
        for own, kind, n, data, logp in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4), strict=True):
            if own != block:
                block, parts, table = own, [], None
            if kind == 0:
                parts.append((_unpacked(data.as_buffer(), n), np.frombuffer(logp.as_buffer(), "<f4")))
                continue
            if table is None:  # two tasks that hold parts of a block ask twice
                g = np.concatenate([p for p, _ in parts]) if parts else np.empty(0, np.int64)
                keys, first = np.unique(g, return_index=True)
                table = keys, (np.concatenate([p for _, p in parts])[first] if parts else np.empty(0, "<f4"))
                parts = []
            with pa.ipc.open_stream(data.as_buffer()) as stream:
                t = stream.read_all().combine_chunks()
            size, ppl = [], []
            for low in t.column(2):
                low = low.as_py()
                size.append(len(low or b""))
                total = 0.0
                for g in grams(low) if low else ():
                    hit, p = _found(*table, g)
                    if not hit.all():
                        raise ValueError("an n-gram of a block has no answer")
                    total += float(p.sum(dtype=np.float64))
                ppl.append(float(np.exp(-total / (len(low) + 1))) if low else None)
            yield pa.RecordBatch.from_arrays([*(t.column(k).combine_chunks() if t.column(k).num_chunks != 1 else t.column(k).chunk(0) for k in (0, 1)), pa.array(size, pa.int64()), pa.array(ppl, pa.float64()), *(t.column(k).chunk(0) for k in (3, 4))], names=["id", "lang", "n_bytes", "perplexity", "n_repeats", "n_pairs"])


def perplexity(docs: DataFrame, trusted: DataFrame, options: Quality = Quality(), *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, n_bytes, perplexity, n_repeats, n_pairs, trusted, held_out), one row for each input row.

    n_repeats of the n_pairs neighbouring words are equal. trusted: frame with the column of ids of trusted documents; held_out: trusted and kept from training. Null and empty texts have no bytes and a null perplexity. A
    document's perplexity is per byte, its closing zero byte included. The model is trained on all trusted documents but those held out. Repeated rows are scored one by one. Very long texts
    are looked at in stretches. Columns other than the three named are not read.
    """
    ids = trusted.select(F.col(id_col).alias("id")).where("id is not null").where(~_is_held_out(F.col("id"), options)).distinct()
    rows = _in_blocks(docs, options.block, id_col, text_col, lang_col)
    trained = _of_ids(rows, ids).mapInArrow(freeing(_counted), "g long, n long")
    model = fit(trained.groupBy("g").agg(F.sum("n").alias("c")))
    answers = _answered(rows.select("block", "text").mapInArrow(freeing(_asked), ROW), model)
    both = answers.unionByName(rows.select("id", "lang", "text", "block").mapInArrow(freeing(_texts), ANSWER))
    kind = docs.schema[id_col].dataType.simpleString()
    scored = settled(both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(freeing(_scored), f"id {kind}, lang string, n_bytes long, perplexity double, n_repeats long, n_pairs long"))
    known = trusted.select(F.col(id_col).alias("id")).where("id is not null").distinct().withColumn("ok", F.lit(True))
    trust = F.coalesce("ok", F.lit(False))
    return scored.join(known, "id", "left").select(F.col("id").alias(id_col), "lang", "n_bytes", "perplexity", "n_repeats", "n_pairs", trust.alias("trusted"), (trust & F.coalesce(_is_held_out(F.col("id"), options), F.lit(False))).alias("held_out"))


def _threshold(options: Quality) -> Column:
    """Of trusted documents: the highest of the quantile's empirical estimates over those held out and over the others, and of the log-normal tolerance limit (Natrella's approximation) of those held out."""
    own = F.when(F.col("held_out"), F.col("perplexity"))
    z, c = NormalDist().inv_cdf(options.quantile), NormalDist().inv_cdf(options.confidence)
    n, logs = F.count(own), F.log(own)
    a = 1 - c * c / (2 * F.greatest(n - 1, F.lit(1)))
    k = F.when(a > 0, (z + F.sqrt(z * z - a * (z * z - c * c / F.nullif(n, F.lit(0))))) / F.nullif(a, F.lit(0.0)))
    bound = F.exp(F.avg(logs) + k * F.stddev_samp(logs))
    return F.greatest(F.percentile_approx(own, options.quantile, 10_000), F.percentile_approx(F.when(~F.col("held_out"), F.col("perplexity")), options.quantile, 10_000), bound)


def quality_classifier(docs: DataFrame, trusted: DataFrame, options: Quality = Quality(), *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, n_bytes, perplexity, threshold, kept), one row for each input row.

    kept is false for documents over their language's threshold with the least evidence, for those whose repeated words are over theirs, and for those without text. Null is a language of its own. Without any
    trusted document there is no threshold, and what has text is kept. Repeated rows get equal rows, ties with the threshold are kept. An empty table gives an empty result. Other columns
    are not read, whatever their names; very long texts are as others.
    """
    scored = perplexity(docs, trusted, options, id_col=id_col, text_col=text_col, lang_col=lang_col)
    of = lambda c: F.percentile_approx(c, options.quantile, 10_000)
    rate = ((F.sum("n_repeats") + 1) / (F.sum("n_pairs") + 2)).alias("rate")
    usual = lambda f, *what: F.broadcast(f.groupBy("lang").agg(*what, F.count_if(F.col("held_out")).alias("n")).where(F.col("n") >= options.least).drop("n").withColumnRenamed("lang", "l"))
    good = scored.where("trusted and perplexity is not null")
    first = good.agg(F.count("*").alias("n"), rate).first()
    joined = scored.join(usual(good, rate), F.col("lang").eqNullSafe(F.col("l")), "left").drop("l")  # a row for each language
    joined = joined.withColumn("excess", _excess(F.col("n_repeats"), F.col("n_pairs"), F.coalesce("rate", F.lit(first.rate if first.n else None).cast("double"))))
    good = joined.where("trusted and perplexity is not null")
    limits = _threshold(options).alias("t"), of(F.col("excess")).alias("e")
    every = good.agg(*limits).first()
    joined = joined.join(usual(good, *limits), F.col("lang").eqNullSafe(F.col("l")), "left")
    threshold = F.coalesce("t", F.lit(every.t).cast("double"))
    most = F.greatest(F.coalesce("e", F.lit(every.e).cast("double")), F.lit(options.evidence))
    over = (F.col("n_bytes") + 1) * F.log(F.col("perplexity") / threshold)
    kept = F.col("perplexity").isNotNull() & F.coalesce(over <= options.evidence, F.lit(True)) & F.coalesce(F.col("excess") <= most, F.lit(True))
    return joined.select(id_col, "lang", "n_bytes", "perplexity", threshold.alias("threshold"), kept.alias("kept"))
