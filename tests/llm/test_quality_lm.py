import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from batchplan.llm import quality_lm as module


def lower(b):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def own_discounts(n1, n2, n3, n4):
    """Written apart from the module: Chen and Goodman's estimates where they lie above 0, else half of the count."""
    if not n1:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1 if n2 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0
    d3 = 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5
    return d1 if d1 > 0 else 0.5, d2 if d2 > 0 else 1.0, d3 if d3 > 0 else 1.5


def brute(train, texts):
    """The same model in plain dictionaries over byte strings."""
    n = module.ORDER
    pad = lambda t: b"\0" * (n - 1) + lower(t.encode()) + b"\0"
    counts = {n: Counter(pad(t)[i : i + n] for t in train for i in range(len(t.encode()) + 1))}
    for m in range(n - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    discount, total, left = {}, {}, {}
    for m in counts:
        of = Counter(counts[m].values())
        discount[m] = own_discounts(*(of[k] for k in (1, 2, 3, 4)))
        total[m], left[m] = defaultdict(int), defaultdict(float)
        for g, c in counts[m].items():
            total[m][g[:-1]] += c
            left[m][g[:-1]] += min(discount[m][min(c, 3) - 1], c)

    def p(g, m):
        if not m:
            return 1 / 256
        s = g[n - m :]
        h = s[:-1]
        if h not in total[m]:
            return p(g, m - 1)
        c = counts[m].get(s, 0)
        return (max(c - discount[m][min(c, 3) - 1], 0) if c else 0) / total[m][h] + left[m][h] / total[m][h] * p(g, m - 1)

    for h in [b"\0" * (n - 1), *(g[:-1] for g in list(counts[n])[:5])]:  # probabilities of all next bytes add up to one
        assert math.isclose(sum(p(h + bytes([c]), n) for c in range(256)), 1, rel_tol=1e-9)
    return [math.exp(-np.mean([math.log(p(pad(t)[i : i + n], n)) for i in range(len(t.encode()) + 1)])) if t else None for t in texts]


def corpus():
    rng = random.Random(1)
    words = {"en": ["the", "of", "and", "thing", "Other", "nation"], "fr": ["le", "été", "çà", "ou", "nation"]}
    rows = [(k, " ".join(rng.choices(words[lang], k=rng.randint(5, 60))), lang, "c") for k in range(160) for lang in [rng.choice(["en", "fr"])]]
    junk = [(1000 + k, "".join(chr(rng.randint(33, 255)) for _ in range(80)), "en", None) for k in range(10)]
    return [*rows, *junk, (2000, None, "en", None), (2001, "", None, None), (2002, "the of", None, None), rows[3], rows[3], (None, "the thing", "en", None), (2003, "the thing " * 300, "en", None)]


SCHEMA = "doc_id long, text string, lang string, block string"


@pytest.mark.parametrize("from_file", [True, False])
def test_perplexity(spark, tmp_path, from_file):
    data = corpus()
    docs = spark.createDataFrame(data, SCHEMA)
    if from_file:
        docs.repartition(3).write.parquet(str(tmp_path / "d"))
        docs = spark.read.parquet(str(tmp_path / "d"))
    trusted = spark.createDataFrame([(k,) for k in range(0, 160, 2)], "doc_id long")
    options = module.Quality(block=3000)
    got = module.perplexity(docs, trusted, options).collect()
    out = {r.doc_id for r in got if r.held_out}
    assert out and out < set(range(0, 160, 2))
    train = [t for d, t, *_ in data if d is not None and d < 160 and d % 2 == 0 and d not in out]
    want = dict(zip([(d, t) for d, t, *_ in data], brute(train, [t for _, t, *_ in data]), strict=True))
    assert len(got) == len(data)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r.perplexity)
    for (d, _), ppl in want.items():
        assert all(x == pytest.approx(ppl, rel=1e-4) if ppl is not None else x is None for x in by_id[d])


def test_verdicts(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    trusted = spark.createDataFrame([(k,) for k in range(160)] + [(None,)], "doc_id long")
    got = module.quality_classifier(docs, trusted).collect()
    assert {r.doc_id for r in got if not r.kept} >= {*range(1000, 1010), 2000, 2001} and len(got) == len(corpus())
    assert sum(r.kept for r in got if r.doc_id is not None and r.doc_id < 160) >= 158
    assert module.quality_classifier(docs.limit(0), trusted).collect() == []
    none = module.quality_classifier(docs, trusted.limit(0)).collect()
    assert {r.doc_id for r in none if not r.kept} == {2000, 2001}


def test_repeated_words_are_rejected(spark):
    """Text of frequent words over and over has a low perplexity and is junk nevertheless."""
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdeiorst", k=rng.randint(2, 8))) for _ in range(300)]
    prose = [(k, " ".join(rng.choices(vocab, k=80)), "en", "c") for k in range(200)]
    runs = [(1000 + k, " ".join(rng.choices(vocab, k=20) + [vocab[k]] * 60), "en", "c") for k in range(10)]
    docs = spark.createDataFrame(prose + runs, SCHEMA)
    got = {r.doc_id: r.kept for r in module.quality_classifier(docs, docs.where("doc_id < 200").select("doc_id")).collect()}
    assert not any(got[1000 + k] for k in range(10)) and sum(got[k] for k in range(200)) >= 190


def test_discounts_leave_something_to_unseen_bytes():
    """A discount of 0 gave unseen bytes a probability of 0, so a perplexity and a language's threshold of NaN."""
    assert all(0 < d <= k for n in ([100, 10, 200, 300], [10, 100, 5, 900], [5, 0, 0, 0], [0, 0, 0, 0]) for k, d in zip((1, 2, 3), module._discounts(n), strict=True))


def test_texts_in_stretches(monkeypatch):
    low = module.lowered("The quick Brown été " * 9)
    whole = np.concatenate(list(module.grams(low)))
    padded = b"\0\0\0\0" + low + b"\0"
    assert whole.tolist() == [int.from_bytes(padded[k : k + 5], "big") for k in range(len(low) + 1)]
    for chunk in (1, 5, 7, len(low), len(low) + 1):
        monkeypatch.setattr(module, "CHUNK", chunk)
        assert np.concatenate(list(module.grams(low))).tolist() == whole.tolist()


def test_packed_numbers():
    for g in ([0], [5, 6, 1 << 39], list(range(1000, 3000, 7))):
        assert module._unpacked(module._packed(np.array(g, np.int64)), len(g)).tolist() == g


def test_other_columns_and_ties(spark):
    """Columns with names that the operator uses inside, repeated rows and equal texts in one table."""
    rows = [(k, "the same text in all of them, word for word", "en", "s", 1, 2.0, "l") for k in [*range(40), 7, 7]] + [(99, "x" * 200_000, None, "s", 1, 2.0, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, block string, shard int, perplexity double, l string")
    got = module.quality_classifier(docs, docs.where("doc_id < 30").select("doc_id")).collect()
    assert len(got) == len(rows) and all(r.kept for r in got if r.doc_id < 99) and len({r.perplexity for r in got if r.doc_id < 99}) == 1


def test_trained_on_all_trusted_documents(spark, tmp_path, monkeypatch):
    """At most 50 000 trusted documents were counted."""
    docs = spark.range(72_000).selectExpr("id doc_id", "'ab' text", "'en' lang")
    docs.unionByName(docs.where("doc_id % 2 = 0")).write.parquet(str(tmp_path / "d"))
    docs, counted, fit = spark.read.parquet(str(tmp_path / "d")), [], module.fit
    monkeypatch.setattr(module, "fit", lambda counts: counted.append(counts.agg({"c": "sum"}).first()[0]) or fit(counts))
    got = module.perplexity(docs, docs.where("doc_id % 16 > 0").select("doc_id"))
    assert counted == [3 * got.where("trusted and not held_out").count()] and counted[0] > 3 * 50_000
    monkeypatch.setattr(module, "MOST_MARKS", 0)
    assert module.perplexity(docs, docs.where("doc_id % 16 > 0").select("doc_id")).where("trusted").count() == got.where("trusted").count() and counted[1] == counted[0]
