import re
from urllib.parse import quote

from hypothesis import given, settings
from hypothesis import strategies as st

from batchplan.llm.quality_rules import MEASURES, RULES, ablation, ledger, measure, quality_rules
from batchplan.llm.url_filter import BloomCascade, Rule, parse_rule, url_filter

WORDS = re.compile("[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    lines, seen, dup = [x for x in text.split("\n") if WORDS.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(max_size=80), st.lists(st.sampled_from(["a", "b", "c", "\n", "#", "é", "\x85", "\u00a0"]), max_size=60).map(" ".join)))
def test_measure(text):
    assert measure(text)[:5] == brute(text)


def test_ledger(spark):
    clean = " ".join(f"word{k}" for k in range(40))
    data = [(1, clean, 0), (1, clean, 0), (2, None, 1), (3, "", 1), (4, "same line here\n" * 50, 1), (5, clean.upper(), 1), (6, " ".join(f"w{k}$$" for k in range(30)), 1), (None, clean, 2), (7, "x " * 100_000, 3)]
    frame = spark.createDataFrame(data, "doc_id long, text string, n_words int")
    got = quality_rules(frame).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in got) == [(0, True), (1, True), (1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (7, False)]
    for r in got:
        for k, (_, test) in enumerate(RULES):
            assert bool(r.failed >> k & 1) == eval(test, {m: r[m] for m in MEASURES}), test
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    rows = ledger(frame)
    counts = {r.rule: (r.n_failed, r.n_only) for r in ablation(rows, "v1").collect()}
    bits = [r.failed for r in rows.collect()]
    assert counts == {name: (sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits)) for k, (name, _) in enumerate(RULES)}
    empty = spark.createDataFrame([], "doc_id long, text string, n_words int")
    assert quality_rules(empty).collect() == []
    assert {tuple(r)[1:] for r in ablation(ledger(empty), "v1").collect()} == {(0, 0)}


RULES_ = [parse_rule("allow", "com/"), parse_rule("block", "example.com/en/"), parse_rule("allow", "www.example.com/en/"), parse_rule("block", "net/es/"), parse_rule("block", "net/fr/"), Rule("block", "org")]


def judge(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    host, path = re.match("([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = max((r for r in RULES_ if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.action if best else "allow"


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://COM/", "https://com", "http://Example.com/en/1", "http://a.www.example.com/en/", "http://xexample.com/en/", "x://n.net/es/a?b#c", "x://n.net/es", "x://net/fr/", "http://a.org", "http://a.org?x", "http://É.ORG/p#f", "a://b://c.com/", "http://..com/en/", "http://u@w.example.com:80/en/", "http://a.net/fr/\nx", "http://" + "a." * 5000 + "com/" + "p" * 9000]
    data = [(k, u, "h") for k, u in enumerate(urls)] + [(4, urls[4], None)]
    got = url_filter(spark.createDataFrame(data, "page_id long, url string, host string"), RULES_).collect()
    assert sorted((r.page_id, (r.host, r.path, r.rule, r.verdict)) for r in got) == sorted((k, judge(u)) for k, u, _ in data)
    assert url_filter(spark.createDataFrame([], "page_id long, url string"), RULES_).collect() == []
    got = url_filter(spark.createDataFrame(data, "page_id long, url string, host string"), [], "block").collect()
    assert {(r.rule, r.verdict) for r in got} == {(None, "block")} and len(got) == len(data)


def test_cascade(spark):
    keys = [quote(f"host{k}.example/") for k in range(20_000)]
    listed = spark.createDataFrame([(k,) for k in keys[:3000]] + [(None,)], "key string")
    universe = spark.createDataFrame([(k,) for k in keys] + [(None,)], "key string")
    cascade = BloomCascade.build(listed, universe)
    assert len(cascade.levels) >= 3
    got = universe.select("key", cascade.contains(universe.key).alias("c")).collect()
    assert {r.key for r in got if r.c} == set(keys[:3000])
    nothing = BloomCascade.build(listed.limit(0), universe)
    assert nothing.levels == [] and not any(r.c for r in universe.limit(5).select(nothing.contains(universe.key).alias("c")).collect())
