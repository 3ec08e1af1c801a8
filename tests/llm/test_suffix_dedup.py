import hashlib
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from batchplan.llm import suffix_dedup as module


def brute(data, length):
    bodies = [(t or "").encode() for _, t, *_ in data]
    count = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for (d, *_), b in zip(data, bodies, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(np.count_nonzero(gone[:-1] & ~np.concatenate(([False], gone[:-2])))) if len(b) else 0
        kept = bytes(c for c, g in zip(b, gone[:-1], strict=True) if not g)
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6), max_size=12), max_size=9))
def test_loser_tree(runs):
    merged = list(module.LoserTree([module.front_decode(module.front_code(sorted(set(r)))) for r in runs]))
    want = sorted({x for r in runs for x in r})
    assert [k for k, _ in merged] == want
    assert [s for _, s in merged][1:] == [len(__import__("os").path.commonprefix([a, b])) for a, b in zip(want, want[1:], strict=False)]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=9), st.binary(max_size=9))
def test_common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    assert module.common(a, b, 0) == n and module.common(a, b, n) == n


def test_anchors(monkeypatch):
    rng = np.random.default_rng(1)
    for chunk in (module.CHUNK, 50):
        monkeypatch.setattr(module, "CHUNK", chunk)
        for b in (rng.integers(0, 3, 700, np.uint8), np.zeros(300, np.uint8), np.tile(rng.integers(0, 256, 20, np.uint8), 30)):
            starts = {}
            for p, g, low, high in (x for a in module.anchors(b, 90) for x in zip(*a, strict=True)):
                for d in range(low, high + 1):
                    assert p - d not in starts
                    starts[int(p - d)] = (int(d), int(g))
            assert sorted(starts) == list(range(len(b) - 89))
            windows = {}
            for i, where in starts.items():
                assert windows.setdefault(b[i : i + 90].tobytes(), where) == where
    assert not list(module.anchors(np.zeros(89, np.uint8), 90))


def corpus(length):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(20, 90)) for _ in range(6)]
    out = [prose(rng.randint(0, 120)) for _ in range(25)]
    for _ in range(60):
        out.append(" ".join(x for _ in range(rng.randint(1, 3)) for x in (prose(rng.randint(0, 25)), rng.choice(passages)[rng.randint(0, 40) : rng.choice([None, -20, -60])])))
    near = list(prose(150))
    for _ in range(15):
        copy = list(near)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = "#"
        out.append("".join(copy))
    out += ["z" * 500, "z" * (length - 1), "z" * length, "ab" * 300, "ba" * 200, "line of text\n" * 60, out[0], out[30], out[30], "", None, None, "x"]
    data = [(k, t, 1, "c") for k, t in enumerate(out)]
    return [*data, data[40], data[40], (3, out[50] + "!", None, None), (None, out[60], None, None)]


def test_against_brute_force(spark):
    data = corpus(100)
    frame = spark.createDataFrame(data, "doc_id long, text string, h1 long, copies string").repartition(5)
    key = lambda r: tuple((v is None, v) for v in r)
    got = sorted((tuple(r) for r in module.suffix_dedup(frame, 100).collect()), key=key)
    assert got == sorted(brute(data, 100), key=key)
    assert any(0 < r[2] < r[1] for r in got)


def test_no_documents(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert module.suffix_dedup(frame).collect() == []


def test_spans_and_kept_bytes(spark):
    data = corpus(100)
    frame = spark.createDataFrame(data, "doc_id long, text string, h1 long, copies string").repartition(5)
    found = module.deduplicated(frame, 100).collect()
    texts = Counter((d, (t or "").encode()) for d, t, *_ in data)
    for r in found:
        body = next(b for (d, b), n in texts.items() if n and d == r.doc_id and len(b) == r.n_bytes and rest(b, r.spans) == bytes(r.kept))
        texts[r.doc_id, body] -= 1
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    assert not any(texts.values())
    assert any(len(r.spans) > 1 for r in found)


def rest(body, spans):
    return b"".join(body[a:b] for a, b in zip([0, *(s.end for s in spans)], [*(s.start for s in spans), len(body)], strict=True))


def test_query_returns_the_kept_text(spark, tmp_path):
    """A character that a removed run cuts in two is marked, all others are the input's."""
    from batchplan.llm.catalog import queries

    passage = "".join(chr(0x61 + k * k % 23) for k in range(500))
    data = [(1, f"before é{passage}"), (2, f"other ©{passage} behind"), (3, "clean ß"), (4, None), (5, "copy " * 100), (6, "copy " * 100)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in queries()["op6_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: "before �", 2: "other � behind", 3: "clean ß", 4: "", 5: "", 6: ""}


def test_hashes_of_words():
    """Equal words, and only those, have one hash, wherever they stand and however long they are."""
    rng = random.Random(2)
    words = [bytes(rng.choices(b"ab\x00\xc3", k=rng.choice([*range(1, 10), 16, 17, 63, 64, 65, 72, 200]))) for _ in range(400)]
    kept = {}
    for gaps in (b" ", b"\n\t  ", b"\x0b"):
        for text in (gaps.join(words), gaps + gaps.join(words[::-1]) + gaps):
            got = module.spoken(np.frombuffer(text, np.uint8)).tolist()
            assert len(got) == len(words)
            assert all(kept.setdefault(w, h) == h for w, h in zip(words if text[:1] not in gaps else words[::-1], got, strict=True))
    assert len(set(kept.values())) == len(kept)
    assert not len(module.spoken(np.frombuffer(b" \n", np.uint8))) and not len(module.spoken(np.zeros(0, np.uint8)))


def test_shared_words_against_brute_force(spark):
    """Strings of 12 words that another row holds, most of them under 100 bytes; repeats inside one row and shorter ones do not count."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 7)))
    prose = lambda n: rng.choice([" ", "\n", " \t"]).join(word() for _ in range(n))
    passages = [prose(n) for n in (11, 12, 13, 20, 60)]
    out = [f"{prose(rng.randint(0, 30))} {rng.choice(passages)}  {prose(rng.randint(0, 30))}\n" for _ in range(40)]
    out += ["own " * 30, f"{prose(4)} of{' of' * 11}", f"of{' of' * 10}", f" of{' of' * 40}", prose(11), prose(12), prose(90), None, "", f"{passages[3]} x {passages[3]}".upper()]
    out += out[-6:] + out[:3] + [" ".join([prose(20)] * 3)]
    data = [(None if k == 3 else k // 2, t) for k, t in enumerate(out)]
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in data]
    holders = {}
    for k, w in enumerate(split):
        for i in range(len(w) - 11):
            holders.setdefault(tuple(w[i : i + 12]), set()).add(k)
    want = [(d, t or "", len({i + j for i in range(len(w) - 11) if len(holders[tuple(w[i : i + 12])]) > 1 for j in range(12)})) for (d, t), w in zip(data, split, strict=True)]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.n_bytes, r.n_shared_words) for r in module.deduplicated(frame, 100, 12).collect()]
    assert Counter(got) == Counter((d, len(t.encode()), n) for d, t, n in want)
    assert any(n and len(t.encode()) < 100 for _, t, n in want) and any(0 < n < 30 for _, _, n in want)


def test_query_tells_of_passages_too_short_to_remove(spark, tmp_path):
    from batchplan.llm.catalog import queries

    passage = " ".join(f"w{k}" for k in range(51))
    data = [(1, f"before {passage}"), (2, f"{passage} behind"), (3, "clean"), (4, passage.replace("w9", "w", 1)), (5, passage[3:]), (6, None)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_shared_words) for r in queries()["op6_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: (0, 51), 2: (0, 51), 3: (0, 0), 4: (0, 0), 5: (0, 0), 6: (0, 0)}
