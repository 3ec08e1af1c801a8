"""Length tables: (idx, token_len, word_len, char_len, text) of a corpus, in one narrow pass without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f]"
WORD = r"[^ \t\n\r\f]+"


def word_units(text: Column) -> Column:
    """Each word with the white space before it; joined, the text up to its last word."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{SPACE}*{WORD}"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")).cast("bigint")


def whitespace_lengths(corpus: DataFrame, max_length: int = 512, *, id_col: str = "doc_id", text_col: str = "text", special_tokens: int = 0, strategy: str = "offsets", keep: tuple[str, ...] = ()) -> DataFrame:
    """Lengths under a tokenizer whose tokens are words, cut at max_length tokens with special_tokens among them.

    strategy offsets: the kept text ends with the last kept word. strategy decode: the kept words joined by single spaces are laid over
    the original, and white space behind is kept; a text that was not shortened stays whole. Null texts count as empty.
    """
    room = max(0, max_length - special_tokens)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = corpus.select(F.col(id_col).alias("idx"), *keep, text.alias("full"), word_units(text).alias("units"))
    kept = F.least(F.size("units"), F.lit(room))
    if strategy == "offsets":
        cut = F.array_join(F.slice("units", 1, room), "") if room else F.lit("")
    elif strategy == "decode":
        decoded = F.length(F.array_join(F.transform(F.slice("units", 1, max(room, 1)), lambda u: F.regexp_replace(u, f"^{SPACE}+", "")), " ")) if room else F.lit(0)
        behind = F.length(F.regexp_extract(F.substring("full", decoded + 1, F.length("full")), f"^{SPACE}*", 0))
        cut = F.when(decoded < F.length("full"), F.substring("full", F.lit(1), decoded + F.when(decoded > 0, behind).otherwise(F.when(F.lit(room) > 0, behind).otherwise(0)))).otherwise(F.col("full"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    rows = rows.select("idx", *keep, (kept + special_tokens).cast("bigint").alias("token_len"), cut.alias("text"))
    return rows.select("idx", *keep, "token_len", word_count(F.col("text")).alias("word_len"), F.length("text").cast("bigint").alias("char_len"), "text")


def tokenizer_lengths(corpus: DataFrame, tokenizer_path: str, max_length: int = 512, *, id_col: str = "doc_id", text_col: str = "text", strategy: str | None = None) -> DataFrame:
    """Lengths under a tokenizer file of the tokenizers library; special tokens count.

    strategy None asks the tokenizer: offsets if it reports them, else decode. Texts go to the library in batches of
    200, the result does not depend on it.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)
        tok.enable_truncation(max_length)
        how = strategy or ("offsets" if tok.encode("probe").offsets else "decode")
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            rows: list[tuple[int, str]] = []
            for first in range(0, len(texts), 200):
                part = texts[first : first + 200]
                for text, e in zip(part, tok.encode_batch(part), strict=True):
                    if how == "offsets":
                        cut = text[: max((end for _, end in e.offsets if end), default=0)]
                    else:
                        plain = tok.decode(e.ids, skip_special_tokens=True)
                        cut = text
                        if len(plain) < len(text):
                            end = min(len(plain.rstrip()), len(text))
                            while end < len(text) and text[end].isspace():
                                end += 1
                            cut = text[:end]
                    rows.append((len(e.ids), cut))
            yield pa.RecordBatch.from_arrays([ids, pa.array([n for n, _ in rows], pa.int64()), pa.array([len(c.split()) for _, c in rows], pa.int64()), pa.array([len(c) for _, c in rows], pa.int64()), pa.array([c for _, c in rows], pa.string())], names=["idx", "token_len", "word_len", "char_len", "text"])

    kind = corpus.schema[id_col].dataType.simpleString()
    rows = corpus.select(F.col(id_col).alias("idx"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(measure, f"idx {kind}, token_len bigint, word_len bigint, char_len bigint, text string")


def precomputed_lengths(corpus: DataFrame, lengths: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Given lengths (idx, token_len, word_len, char_len) instead of a tokenizer; texts are not cut. All three, for exactly the corpus's ids."""
    missing = {"idx", "token_len", "word_len", "char_len"} - set(lengths.columns)
    if missing:
        raise ValueError(f"token, word and char lengths come together; missing: {sorted(missing)}")
    texts = corpus.select(F.col(id_col).alias("idx"), F.col(text_col).alias("text"), F.lit(1).alias("here"))
    both = lengths.select("idx", "token_len", "word_len", "char_len", F.lit(1).alias("given")).join(texts, "idx", "full")
    bad = both.where("here is null or given is null or token_len is null or word_len is null or char_len is null").count()
    if bad:
        raise ValueError(f"lengths and texts differ in {bad} rows")
    return both.select("idx", "token_len", "word_len", "char_len", "text")


def offline_lengths(corpus: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(idx, word_len, char_len) of whole texts as the training log has them: words are what single spaces part."""
    return corpus.select(F.col(id_col).alias("idx"), F.size(F.split(text_col, " ")).cast("bigint").alias("word_len"), F.length(text_col).cast("bigint").alias("char_len"))


def id_violations(batches: DataFrame, ids_col: str, vocabulary_size: int) -> DataFrame:
    """One row: how many rows hold an id outside 0 .. vocabulary_size - 1."""
    return batches.agg(F.count_if(F.exists(ids_col, lambda x: (x < 0) | (x >= vocabulary_size))).alias("n_bad"))
