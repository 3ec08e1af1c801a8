import hashlib
import random
import re

import pytest

from batchplan.llm import decontaminate as module

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items, width):
    own, hit, found = WORD.findall(lower(text)), set(), set()
    for item, body in items:
        w = WORD.findall(lower(body))
        for i in range(max(1, len(w) - width + 1)) if w and item is not None else ():
            window = w[i : i + width]
            for p in range(len(own) - len(window) + 1):
                if own[p : p + len(window)] == window:
                    hit |= set(range(p, p + len(window)))
                    found.add(str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def cases():
    rng = random.Random(4)
    vocabulary = ["The", "a", "é", "Éb", "x1", "of", "zz", "日本", "i̇", "q"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 5, 8, 14])))) for k in range(25)]
    items += [(3, "a a a a a a a"), (7, None), (None, "of of"), (100, "..."), (11, items[4][1]), (11, items[4][1])]
    docs = [(k, "; ".join(rng.choices(vocabulary, k=rng.randint(0, 60))), "c", "d") for k in range(60)]
    docs += [(70 + k, f"zz-{body}. q", None, None) for k, (_, body) in enumerate(items[:12])]
    docs += [(5, None, None, None), (6, "", None, None), docs[3], docs[3], (None, docs[9][1], None, None), (90, "a " * 4000, None, None)]
    return docs, items


@pytest.mark.parametrize("most", [module.MOST_BROADCAST, 0])
def test_against_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(module, "MOST_BROADCAST", most)
    docs, items = cases()
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = module.decontaminate(frame, bench, 5).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(((d, *brute(t, items, 5)) for d, t, *_ in docs), key=key)
    assert module.decontaminate(frame.limit(0), bench, 5).collect() == []
    assert all(not r.contaminated for r in module.decontaminate(frame, bench.limit(0), 5).collect())
