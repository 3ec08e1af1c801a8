"""Quality rules as a bitmask ledger.

Every measurement is taken once and every rule evaluated once; the ledger keeps the measurements and one failure bit for
each rule. A policy is a version name and a mask of the rules that count: verdicts, and what each rule alone changes,
come from bitwise operations on the ledger without reading text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchplan.llm.spark_io import freeing

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_alpha")
#: In bit order; a new rule is only ever added at the end, so that old ledgers keep their meaning.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("capitals", "100 * n_upper > 60 * n_alpha"),
    ("few_letters", "100 * n_alpha < 50 * word_chars"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 25 * n_words"),
)
BASE = ("few_words", "repeated_windows")
#: Versions of the verdict: the rules that count.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": tuple(name for name, _ in RULES)}
_SPACES, _SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"


def mask(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


def _repeated(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of `width` words that occur twice or more; windows are told apart exactly, by names of their halves."""
    if len(words) <= width:
        return 0
    seen: dict[bytes, int] = {}
    name = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    step = 1
    while step < width:
        if len(name) <= step:
            return 0
        kinds, name = np.unique(name[:-step] * (int(name.max()) + 1) + name[step:], return_inverse=True)
        if len(kinds) == len(name):
            return 0
        step *= 2
    again = np.flatnonzero(np.bincount(name)[name] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + width, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    alpha = sum(map(str.isalpha, text))
    return (len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), _repeated(words), len(lines), upper, alpha)


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the measurements, failed): one row for each input row; failed holds one bit for each rule that the text fails.

    Null text is empty text: no words, so it fails few_words. Repeated rows are judged one by one; other columns are not read;
    an empty table gives an empty ledger. Texts are measured whole, one at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measure(t) for t in b.column(1).to_pylist()]
            columns = zip(*found, strict=True) if found else [[] for _ in MEASURES]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["id", *MEASURES])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(freeing(take), f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = sum((F.when(F.expr(test), F.lit(1 << k)).otherwise(0) for k, (_, test) in enumerate(RULES)), F.lit(0))
    return rows.withColumn("failed", bits.cast("long")).withColumnRenamed("id", id_col)


def passes(policy: str) -> Column:
    """Whether a ledger row passes the policy of this version."""
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """(rule, n_failed, n_only): rows that fail each rule, and rows that would pass the policy without it.

    One aggregation to at most 2^rules bit patterns, then bitwise tests on those; an empty ledger gives zeros.
    """
    counted = POLICIES[policy]
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask(counted))).alias("bits")).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    sums = [F.struct(F.lit(r).alias("rule"), F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(mask((r,)))) != 0, F.col("n"))), zero).alias("n_failed"), F.coalesce(F.sum(F.when(F.col("bits") == mask((r,)), F.col("n"))), zero).alias("n_only")) for r in counted]
    return patterns.agg(F.array(*sums).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def quality_rules(docs: DataFrame, policy: str = "v1", *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger with base_failed and kept (no rule of the policy fails). Cases as in ledger()."""
    return ledger(docs, id_col=id_col, text_col=text_col).withColumns({"base_failed": ~passes("base"), "kept": passes("base") & passes(policy)})
