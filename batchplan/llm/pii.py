"""Personal data: patterned entities, and the terms that give them away, in DataFrame operations only.

Base spans (email, ip, card, phone) are found in each row. Around them, terms are counted with the entity they stand
beside: n(t, e) over distinct contexts. Support counts those of them that are no near copies of another, so neither
copies nor near copies are evidence. Of a term with enough support, the share
P(e|t) = n(t, e) / n(t), with n(t) over the distinct texts of the whole corpus, says how surely the term reveals the
entity, and log2(P(e|t) / P(e)) how many bits it discloses. Terms above both thresholds become spans of kind
`term` wherever they stand: removed if the share is near one, else generalised.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchplan.llm.decontaminate import lowered, words
from batchplan.llm.spark_io import settled, unused, written

_LOCAL = "A-Za-z0-9._%+-"
#: The base patterns with possessive runs and run starts, so that failing is linear; they match the same leftmost spans as
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), [0-9]([\x20-]?[0-9])+
#: and \+[0-9][\x20().0-9-]+[0-9]; lone digits of the third are dropped with the other short ones.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
#: What a text must hold for the pattern to be tried.
_NEEDS = {"email": "@", "phone": "+"}
SPAN = "array<struct<start:int,end:int,value:string>>"
#: Terms are sent to every task up to so many rows; beyond it they are shuffled.
MOST_BROADCAST = 200_000
#: Keys of texts that hold terms, or spans of terms, are sent to every task up to so many (some 60 bytes each); beyond it they meet their rows by a shuffle.
MOST_HOLDERS = 500_000


@dataclass(frozen=True)
class Disclosure:
    """Thresholds: characters of context on either side; contexts that a term and an entity must share, near copies
    counted once; own, the least share of a context's words that stand in under half of the entity's contexts, under which it is
    a near copy of the others; share and bits above which a term discloses; share from which it is removed."""

    context: int = 100
    support: int = 3
    own: float = 0.2
    share: float = 0.5
    bits: float = 4.0
    remove: float = 0.9


def _matches(text: Column, pattern: str, tried: Column, valid) -> Column:
    """The pattern's spans in code points: what stands between matches and the matches take turns, so lengths add up to places."""
    gaps = F.when(tried, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))
    found = F.when(tried, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    turns = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))

    def step(a: Column, t: Column) -> Column:
        start, end = a.at + t.g, a.at + t.g + F.coalesce(F.length(t.m), F.lit(0))
        own = F.array(F.struct(start.alias("start"), end.alias("end"), t.m.alias("value")))
        return F.struct(end.alias("at"), F.when(t.m.isNotNull() & valid(t.m), F.concat(a.out, own)).otherwise(a.out).alias("out"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda a: a.out)


def _ip_valid(m: Column) -> Column:
    return F.forall(F.split(m, "[.]"), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255))


def _card_valid(m: Column) -> Column:
    digits = F.split(F.regexp_replace(m, "[^0-9]", ""), "")
    n = F.size(digits)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, doubled(d.cast("int"))).otherwise(d.cast("int"))), F.lit(0), lambda a, d: a + d)
    return F.when(F.length(F.regexp_replace(m, "[^0-9]", "")).between(13, 19), total % 10 == 0).otherwise(False)


def _phone_valid(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)


_VALID = {"email": lambda m: F.lit(True), "ip": _ip_valid, "card": _card_valid, "phone": _phone_valid}


def base_spans(text: Column) -> dict[str, Column]:
    """Valid spans of each kind, in order of their start. Null and empty texts have none."""
    text = F.coalesce(text, F.lit(""))
    digits = {"ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")}
    return {k: _matches(text, p, text.contains(_NEEDS[k]) if k in _NEEDS else digits[k], _VALID[k]) for k, p in PATTERNS.items()}


def _whole(text: Column, cut: Column, at_end: bool) -> Column:
    """The text without the word, or else the one character, at the end (or the start) where it is cut."""
    return F.when(cut, F.regexp_replace(text, rf"(?:{_WORD}|(?s:.))\z" if at_end else rf"\A(?:{_WORD}|(?s:.))", "")).otherwise(text)


def _based(rows: DataFrame, limits: Disclosure) -> DataFrame:
    """(id, h, a column of spans for each kind, around), written once without the texts of rows (id, h, text).

    around holds (entity, before, after) of every span, with one character more than asked for on either side, which tells whether a word goes on beyond the context.
    """
    c = limits.context + 1

    def named(kind: str):
        before = lambda s: F.substring("text", F.greatest(s.start - c, F.lit(0)) + 1, F.least(s.start, F.lit(c)))
        return lambda s: F.struct(F.concat(F.lit(f"{kind}:"), F.lower(s.value)).alias("entity"), before(s).alias("before"), F.substring("text", s.end + 1, F.lit(c)).alias("after"))

    found = rows.select("*", *(spans.alias(k) for k, spans in base_spans(F.col("text")).items()))
    return written(found.select("id", "h", *PATTERNS, F.concat(*(F.transform(F.col(k), named(k)) for k in PATTERNS)).alias("around")))


def disclosing_terms(based: DataFrame, rows: DataFrame, limits: Disclosure) -> tuple[DataFrame, DataFrame]:
    """(word, entity, share, bits, action) of the terms that disclose an entity, and (id, h, word) of the texts that hold a candidate, both settled.

    Terms are words of any length, A-Z lower-cased; which of them disclose is left to support, share and bits. based is that of the rows (id, h, text).
    """
    # A word that runs into the entity is none of the text's.
    around = based.select("h", F.explode("around").alias("s")).select("s.entity", "h", "s.before", "s.after")
    value = F.regexp_replace("entity", r"\A[a-z]+:", "")
    before = F.when(value.rlike(rf"\A{_WORD}"), F.regexp_replace("before", rf"{_WORD}\z", "")).otherwise(F.col("before"))
    after = F.when(value.rlike(rf"{_WORD}\z"), F.regexp_replace("after", rf"\A{_WORD}", "")).otherwise(F.col("after"))
    around = around.select("entity", "h", _whole(before, F.length("before") > limits.context, False).alias("before"), _whole(after, F.length("after") > limits.context, True).alias("after"))
    contexts = settled(around.groupBy("entity", "before", "after").agg(F.min("h").alias("h")))
    contexts = contexts.withColumn("words", F.array_distinct(F.transform(F.concat(words(F.col("before")), words(F.col("after"))), lowered)))
    entities = contexts.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= limits.support)
    # Fewer contexts cannot lend any term its support. An entity has at most twice as many usual words as a context has words.
    held = contexts.join(entities, "entity")
    usual = held.select("entity", "n_e", F.explode("words").alias("word")).groupBy("entity", "n_e", "word").agg(F.count("*").alias("n")).where(2 * F.col("n") >= F.col("n_e"))
    usual = usual.groupBy("entity").agg(F.collect_list("word").alias("usual"))
    owned = held.join(usual, "entity", "left").withColumn("rare", F.array_except("words", F.coalesce("usual", F.array().cast("array<string>"))))
    # Near copies share a sketch: none if nearly all their words are usual, else the two smallest hashes of the others.
    sketch = F.when(F.size("rare") >= F.greatest(F.lit(1.0), limits.own * F.size("words")), F.slice(F.array_sort(F.transform("rare", lambda w: F.xxhash64(w))), 1, 2))
    seen = owned.select("entity", F.xxhash64(sketch).alias("sketch"), F.explode("words").alias("word"))
    near = contexts.select("entity", "h", F.explode("words").alias("word"))
    met = seen.groupBy("entity", "word", "sketch").agg(F.count("*").alias("n")).groupBy("entity", "word").agg(F.sum("n").alias("n_te"), F.count("*").alias("n_own"))
    met = met.where(F.col("n_own") >= limits.support).drop("n_own")
    # The texts whose contexts hold the term are among those that hold it: a share too low here needs no look at the corpus.
    least = near.groupBy("word", "h").agg(F.lit(1).alias("x")).groupBy("word").agg(F.count("*").alias("n_c"))
    pairs = settled(met.join(least, "word").where(F.col("n_te") >= limits.share * F.col("n_c")).join(entities, "entity").select("entity", "word", "n_te", "n_e"))
    n = pairs.select("word").distinct().count()
    if not n:
        none = pairs.select("word", "entity", F.lit(0.0).alias("share"), F.lit(0.0).alias("bits"), F.lit("").alias("action")).limit(0)
        return none, rows.select("id", "h", F.lit("").alias("word")).limit(0)
    terms = pairs.select("word").distinct()
    sent = F.broadcast(terms) if n <= MOST_BROADCAST else terms
    holders = written(rows.select("id", "h", F.explode(F.array_distinct(F.transform(words(F.col("text")), lowered))).alias("word")).join(sent, "word").select("id", "h", "word"))
    frequency = holders.groupBy("word", "h").agg(F.lit(1).alias("x")).groupBy("word").agg(F.count("*").alias("n_t"))
    total = based.agg(F.count_distinct("h").alias("n")).first().n
    scored = pairs.join(frequency, "word").withColumn("share", F.least(F.lit(1.0), F.col("n_te") / F.col("n_t"))).withColumn("bits", F.log2(F.col("share") * total / F.col("n_e")))
    chosen = scored.where((F.col("share") >= limits.share) & (F.col("bits") >= limits.bits))
    return settled(chosen.select("word", "entity", "share", "bits", F.when(F.col("share") >= limits.remove, "remove").otherwise("generalise").alias("action"))), holders


def _sent(frame: DataFrame, n: int) -> DataFrame:
    return F.broadcast(frame) if n <= MOST_HOLDERS else frame


def _places(based: DataFrame, rows: DataFrame, limits: Disclosure) -> DataFrame | None:
    """(id, h, term): spans of the disclosing terms in every text that holds one, each (id, h) once; None without terms. Only texts that hold a term are read for them."""
    terms, holders = disclosing_terms(based, rows, limits)
    actions = terms.groupBy("word").agg(F.max("action").alias("action"))  # remove before generalise
    n = actions.count()
    if not n:
        return None
    sent = F.broadcast(actions) if n <= MOST_BROADCAST else actions
    keys = settled(holders.join(sent, "word").select("id", "h").distinct())
    same = F.col("r.id").eqNullSafe(F.col("k.id")) & (F.col("r.h") == F.col("k.h"))
    texts = rows.alias("r").join(_sent(keys, keys.count()).alias("k"), same, "left_semi").groupBy("id", "h").agg(F.first("text").alias("text"))
    text = F.coalesce("text", F.lit(""))
    turns = F.arrays_zip(F.split(text, _WORD, -1).alias("g"), F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("m"))
    each = texts.select("id", "h", F.posexplode(turns).alias("i", "t")).select("id", "h", "i", F.length("t.g").alias("g"), F.col("t.m").alias("m"))
    run = Window.partitionBy("id", "h").orderBy("i")
    each = each.withColumn("end", F.sum(F.col("g") + F.coalesce(F.length("m"), F.lit(0))).over(run).cast("int")).where("m is not null").withColumn("word", lowered(F.col("m")))
    span = F.struct((F.col("end") - F.length("m")).alias("start"), "end", F.col("action").alias("value"))
    return settled(each.join(sent, "word").groupBy("id", "h").agg(F.array_sort(F.collect_list(span)).alias("term")))


def _with_terms(frame: DataFrame, i: str, h: str, places: DataFrame, term: str) -> DataFrame:
    """The frame, whose columns i and h are a text's id and hash, with the spans of its terms."""
    n = places.agg(F.coalesce(F.sum(F.size("term") + 1), F.lit(0)).alias("n")).first().n
    pi, ph = unused([*frame.columns, term], "__pi"), unused([*frame.columns, term], "__ph")
    places = places.withColumnsRenamed({"id": pi, "h": ph, "term": term})
    joined = frame.join(_sent(places, n), F.col(i).eqNullSafe(F.col(pi)) & (F.col(h) == F.col(ph)), "left").drop(pi, ph)
    return joined.withColumn(term, F.coalesce(term, F.array().cast(SPAN)))


def find_spans(docs: DataFrame, limits: Disclosure = Disclosure(), *, id_col: str = "doc_id", text_col: str = "text", found_col: str = "found") -> DataFrame:
    """The input's rows with a column of the name found_col: a struct of one array of (start, end, value) for each kind, in code points, end exclusive; value is the text, for terms the action.

    Null and empty texts have no spans. Repeated rows get equal spans; rows of one id with other texts are judged apart. Columns of
    the input keep their names and values; one named found_col is replaced. An empty table gives an empty result. Whole texts cross the
    network only where they hold a term, or if there are more spans of terms than MOST_HOLDERS.
    """
    own = docs.drop(found_col)
    base = F.struct(*(c.alias(k) for k, c in base_spans(F.col(text_col)).items()))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    places = _places(_based(rows, limits), rows, limits)
    if places is None:
        return own.withColumn(found_col, base.withField("term", F.array().cast(SPAN)))
    term, key = unused(own.columns, "__term"), unused(own.columns, "__key")
    joined = _with_terms(own.withColumn(key, F.xxhash64(text_col)), id_col, key, places, term)
    return joined.withColumn(found_col, base.withField("term", F.col(term))).drop(key, term)


def _listed(kinds: tuple[str, ...]) -> Column:  # of the column `found`
    """kind:start:end of every span, by kind as listed, then start, comma-joined."""
    named = lambda k: lambda s: F.concat_ws(":", F.lit(k), s.start, s.end)
    return F.array_join(F.concat(*(F.transform(F.col(f"found.{k}"), named(k)) for k in kinds)), ",")


def pii_report(docs: DataFrame, limits: Disclosure = Disclosure(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans), one row for each input row. Cases as in find_spans()."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    based = _based(rows, limits)
    places = _places(based, rows, limits)
    spans = based.drop("around")
    spans = spans.withColumn("term", F.array().cast(SPAN)) if places is None else _with_terms(spans, "id", "h", places, "term")
    found = spans.select(F.col("id").alias(id_col), F.struct(*KINDS).alias("found"))
    counts = [F.size(f"found.{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(_listed(tuple(PATTERNS)), 256).alias("base_sha256"), _listed(KINDS).alias("spans"))


def sanitise(docs: DataFrame, limits: Disclosure = Disclosure(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns; in the text each stretch of overlapping spans is replaced by the first one's kind in angle brackets, removed terms by nothing.

    Null texts stay null. Other cases as in find_spans().
    """
    marked = lambda k: lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.when(F.lit(k == "term") & (s.value == "remove"), "").otherwise(F.lit(f"<{k.upper()}>")).alias("mark"))
    name = unused(docs.columns, "__found")
    spans = F.array_sort(F.concat(*(F.transform(F.col(f"{name}.{k}"), marked(k)) for k in KINDS)))

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text_col, a.at + 1, F.greatest(s.start - a.at, F.lit(0))), F.when(s.start >= a.at, s.mark).otherwise(""))
        return F.struct(F.greatest(a.at, s.end).alias("at"), F.concat(a.out, F.array(piece)).alias("out"))

    clean = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        step,
        lambda a: F.concat(F.array_join(a.out, ""), F.substring(text_col, a.at + 1, F.length(text_col))),
    )
    found = find_spans(docs, limits, id_col=id_col, text_col=text_col, found_col=name)
    names = [c for c in docs.columns]
    return found.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(F.col(text_col))).select(*names)
