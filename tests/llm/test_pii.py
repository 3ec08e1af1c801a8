import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from batchplan.llm import pii as module

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m.group())] for k, p in BASE.items()}


def texts():
    rng = random.Random(2)
    parts = ["a@b.c", "_d@e.f.g", "x.y+z@", "@@", "1.2.3.4", ".5.6", "300.1.1.1", "0000255.0.0.01", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+49", "é", "😀", " ", "\n", "-", "5", "12 34", "79927398713", "word", "+", "1" * 30, "99999999999999999999.1.1.1"]
    own = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(300)]
    return [*own, None, "", "a" * 20_000, "1 " * 20_000, "1." * 20_000, "+1 2-" * 3000, "me@x.org " * 300]


def test_base_spans(spark):
    data = [(k, t, "c") for k, t in enumerate(texts())] + [(3, "a@b.c", None), (3, "a@b.c", None), (None, "a@b.c", None)]
    frame = spark.createDataFrame(data, "doc_id long, text string, found string")
    none = module.Disclosure(support=10**9)
    want = []
    for d, t, _ in data:
        spans = brute(t)
        listed = ",".join(f"{k}:{a}:{e}" for k in BASE for a, e in spans[k])
        want.append((d, *(len(spans[k]) for k in BASE), 0, hashlib.sha256(listed.encode()).hexdigest(), listed))
    key = lambda r: tuple((v is None, v) for v in r)
    got = [tuple(r) for r in module.pii_report(frame, none).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert module.pii_report(frame.limit(0)).collect() == []


@pytest.mark.parametrize("most", [module.MOST_BROADCAST, 0])
def test_terms(spark, most, monkeypatch):
    monkeypatch.setattr(module, "MOST_BROADCAST", most)
    mail, limits = "ceo@corp.example", module.Disclosure(bits=1.0)
    data = [(k, f"Report {'abcdefghij'[k] * 5} by Zorblatt of the {'klmnopqrst'[k] * 5} office, {'uvwxyzabcd'[k] * 5} {mail} now") for k in range(6)]
    data += [(20 + k, f"the office of number {'abcdefghij'[k % 10] * 6} write now and report") for k in range(60)]
    data += [(90, "it is ZORBLATT, zorblatt's idea"), (91, None), (90, "it is ZORBLATT, zorblatt's idea"), (None, "Zorblatt")]
    data += [(100 + k, f"{'abcdefghij'[k] * 5} near copies of unique quagga at q@q.qq, no evidence") for k in range(6)]
    data += [(92, "copy unique_zebra x@y.zz")] * 9  # copies are no evidence
    frame = spark.createDataFrame(data, "doc_id long, text string")
    got = {(r.doc_id, r.spans) for r in module.pii_report(frame, limits).collect()}
    assert (90, "term:6:14,term:16:24") in got and (91, "") in got and (None, "term:0:8") in got and (92, "email:18:24") in got
    assert {s for d, s in got if d is not None and 20 <= d < 80} == {""}
    clean = module.sanitise(frame.withColumn("__base", F.lit(1)).drop("__base"), limits).collect()
    assert len(clean) == len(data) and not any("zorblatt" in (r.text or "").lower() or "@" in (r.text or "") for r in clean)
    assert "copy unique_zebra <EMAIL>" in {r.text for r in clean}
    assert module.sanitise(frame.limit(0), limits).collect() == []


def test_sanitise_overlaps(spark):
    frame = spark.createDataFrame([(1, "call +1 555 123 4567 x", 5), (2, "é 4111 1111 1111 1111", 6), (3, None, 7), (4, "ip 1.2.3.4, 5.6.7.8.", 8)], "doc_id long, text string, n long")
    got = {r.doc_id: (r.text, r.n) for r in module.sanitise(frame).collect()}
    assert got == {1: ("call <PHONE> x", 5), 2: ("é <CARD>", 6), 3: (None, 7), 4: ("ip <IP>, <IP>.", 8)}


def spelled(k, n=6):
    return "".join("abcdefghij"[int(c)] for c in f"{k:0{n}d}")


def test_terms_in_one_phrase_and_of_hot_entities(spark):
    """The words that touch the entity may always be the same, and be few for its many contexts; near copies are no evidence."""
    filler = lambda k: " ".join(spelled(13 * k + j) for j in range(1, 7))
    data = [(k, f"{filler(k)} Contact Jane Zorblatt at x@y.com today {filler(k + 500)}") for k in range(0, 300, 7)]
    data += [(1000 + k, f"{spelled(k)} near copies of unique quagga stand here at q@q.qq but that is no evidence at all") for k in range(40)]
    data += [(2000 + k, f"nothing here {filler(k + 5000)}") for k in range(400)] + [(9000, "only Zorblatt"), (9001, "only quagga")]
    got = {r.doc_id: r.n_term for r in module.pii_report(spark.createDataFrame(data, "doc_id long, text string"), module.Disclosure(bits=1.0)).collect()}
    assert got[9000] == 1 and got[0] > 0 and got[9001] == 0


def test_fragments_at_the_edges_are_no_words(spark):
    """'port' discloses the entity; contexts that begin inside 'support', or words that run into an entity, say nothing about it."""
    pad = lambda k, n: " ".join(spelled(97 * k + j, 5) for j in range(1, 40))[:n]
    data = [(k, f"{spelled(k)} {pad(k, 30)} port {pad(k + 50, 30)} a@b.cc {pad(k + 99, 30)}") for k in range(3)] + [(3, "a port alone")]
    # 'port' are the first four of the 100 characters before the address
    data += [(10 + k, f"{pad(k + 200, 20)} support {pad(k + 300, 94)} a@b.cc {pad(k + 400, 30)}") for k in range(4)]
    data += [(30 + k, f"{pad(k + 600, 40)} a@b.cc") for k in range(2)] + [(40 + k, f"nothing {pad(k + 700, 50)}") for k in range(80)]
    assert all(t[t.index("a@b.cc") - 100 :].startswith("port ") for d, t in data if 10 <= d < 20)
    got = {r.doc_id: r.n_term for r in module.pii_report(spark.createDataFrame(data, "doc_id long, text string"), module.Disclosure(bits=1.0)).collect()}
    assert got[3] == 1


def test_short_terms_and_account_names(spark):
    data = [(k, f"{spelled(31 * k)} {spelled(37 * k + 5)} {spelled(41 * k + 7)} Li or jdoe42 or \u738b\u4f1f at li@corp.example {spelled(43 * k + 9)} {spelled(47 * k + 11)}") for k in range(1, 9)]
    data += [(100 + k, f"{spelled(k + 7000)} or at") for k in range(200)] + [(900, "Li"), (901, "jdoe42"), (902, "\u738b\u4f1f"), (903, "or at")]
    got = {r.doc_id: r.n_term for r in module.pii_report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(900, 904)] == [1, 1, 1, 0]


@pytest.mark.parametrize("share", [0.5, 2.0])
def test_columns_of_clashing_names(spark, share):
    """With and without disclosing terms, columns named as the operator's own keep names, places and values."""
    names = ["found", "__base", "__h", "__id", "__key", "__term", "__found", "id", "h", "word"]
    rows = [(k, f"{spelled(31 * k)} {spelled(37 * k + 5)} Li at li@corp.example {spelled(43 * k + 9)} {spelled(47 * k + 11)}") for k in range(1, 9)]
    rows += [(100 + k, f"{spelled(k + 7000)} or at") for k in range(200)]
    frame = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    clean = module.sanitise(frame, module.Disclosure(share=share))
    assert clean.columns == frame.columns
    got = clean.collect()
    assert len(got) == len(rows) and all(tuple(r)[2:] == tuple(range(len(names))) for r in got) and not any("@" in r.text for r in got)
    assert any(" Li " in r.text for r in got) == (share > 1)
