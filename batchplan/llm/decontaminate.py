"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A document contains a window of an item only if it contains each of the window's words, so one necessary word is enough to
look for: the window's prefix under an order by rarity, counted over all documents. Documents' words meet the
prefixes in one hash join; the few positions that meet are held to the length and positional bounds and then compared word by
word with the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchplan.llm.spark_io import settled

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything below 0x80 but digits and letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows and words of the benchmark are sent to every task up to so many rows; beyond it they are shuffled.
MOST_BROADCAST = 200_000


def words(text: Column) -> Column:
    """The words as they stand in the text; lowered() makes them comparable. Null gives no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN, -1), "")


def lowered(word: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def item_windows(items: DataFrame, width: int, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, window, size): the windows of `width` words of each item, joined by spaces, or all its words if it has fewer but some."""
    w = items.select(F.col(id_col).cast("string").alias("item"), F.transform(words(F.col(text_col)), lowered).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return w.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, width), " "))).alias("window"), F.least(F.size("w"), F.lit(width)).alias("size")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated), one row for each input row.

    n_hit counts the words inside any occurrence of a window, n_items the items with an occurring window; items_sha256 is of
    their ids as strings, sorted and comma-joined (of the empty string if there are none). Null texts have no words. Items without
    words, or of null id, match nothing. Repeated rows get equal rows; rows of one id with other texts are judged
    apart. Other columns are not read. Empty tables give no rows, or no hits.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), words(F.col(text_col)).alias("w"))

    windows = settled(item_windows(items, width, id_col=item_id_col, text_col=item_text_col).where("item is not null"))
    vocabulary = windows.select(F.explode(F.split("window", " ")).alias("word")).distinct()
    small = windows.count() * width <= MOST_BROADCAST * width and vocabulary.count() <= MOST_BROADCAST
    sent = F.broadcast if small else lambda x: x

    # Rarity: how often each word of the benchmark stands in the documents.
    seen = rows.select(F.explode_outer("w").alias("word")).select(lowered(F.col("word")).alias("word"))
    frequency = seen.join(sent(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    distinct = windows.select("window", "size").distinct()
    each = distinct.select("window", "size", F.posexplode(F.split("window", " ")).alias("at", "word")).join(frequency, "word", "left")
    first = Window.partitionBy("window").orderBy(F.coalesce("n", F.lit(0)), "word", "at")
    prefix = settled(each.withColumn("k", F.row_number().over(first)).where("k = 1 and n is not null").select("word", "at", "window", "size"))

    # The join on the prefix, then the bounds, then the words themselves: all in one generated stage, so that the
    # document's words are only looked at and never copied into a row of their own.
    if small:
        at_words = rows.select("id", "h", "w", F.posexplode_outer("w").alias("p", "word")).withColumn("word", lowered(F.col("word")))
        met = at_words.join(F.broadcast(prefix), "word")
    else:
        at_words = rows.select("id", "h", F.posexplode_outer("w").alias("p", "word")).withColumn("word", lowered(F.col("word")))
        met = at_words.join(prefix, "word").drop("word").alias("m")
        texts = rows.dropDuplicates(["id", "h"]).alias("t")
        met = met.join(texts, F.col("m.id").eqNullSafe(F.col("t.id")) & (F.col("m.h") == F.col("t.h"))).select("m.*", "t.w")
    start = F.col("p") - F.col("at")
    there = (start >= 0) & (start + F.col("size") <= F.size("w"))
    hits = met.where(there & (lowered(F.array_join(F.slice("w", start + 1, F.col("size")), " ")) == F.col("window"))).select("id", "h", "window", start.alias("start"), "size")

    span = F.struct("start", "size")
    places = hits.join(sent(windows.select("item", "window")), "window").groupBy("id", "h").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a.end, s.start + s.size).alias("end"), (a.n + F.greatest(F.lit(0), s.start + s.size - F.greatest(a.end, s.start))).alias("n")),
        lambda a: a.n,
    )
    found = places.select("id", "h", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("names")).alias("f")
    base = rows.select("id", "h", F.size("w").cast("long").alias("n_words")).alias("b")
    out = base.join(found, F.col("b.id").eqNullSafe(F.col("f.id")) & (F.col("b.h") == F.col("f.h")), "left")
    zero = F.lit(0).cast("long")
    n_hit = F.coalesce("n_hit", zero)
    return out.select(F.col("b.id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
