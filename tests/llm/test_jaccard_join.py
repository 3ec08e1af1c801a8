import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from batchplan.llm import components as components_module
from batchplan.llm import jaccard_join as module
from batchplan.llm import shingles
from batchplan.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_set(text, width=3):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(data, width, num, den):
    sets = [brute_set(t, width) for _, t, *_ in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(data):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d if d is not None else -1, len(s), least.get(find(i), -1) if s else (d if d is not None else -1)) for i, ((d, *_), s) in enumerate(zip(data, sets, strict=True)))


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(max_size=60), st.lists(st.sampled_from(["a", "B", "é", "日本", "\n", " ", "\x85", " x"]), max_size=40).map(" ".join)))
def test_shingles(text):
    assert len(shingles.shingle_set(text, 3)) == len(brute_set(text))


def test_shingles_in_chunks(monkeypatch):
    text = "one two\n" + "x" * 100 + " three four  five " * 30
    whole = shingles.words(text)
    monkeypatch.setattr(shingles, "_CHUNK", 7)
    assert shingles.words(text).tolist() == whole.tolist()
    assert not np.array_equal(shingles.shingle_set("a b", 3), shingles.shingle_set("a b a b", 3)[:1])


def test_bitmaps_bound_differences():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2 * n, n).astype(np.uint64)) for n in (3, 200, 900, 6000, 20_000)]
    for a in sets:
        for b in sets:
            assert module._apart_by(module._bitmap(a), module._bitmap(b)) <= len(np.setxor1d(a, b))
    big = [np.unique(rng.integers(0, 1 << 60, 9000).astype(np.uint64)) for _ in range(2)]
    assert module._apart_by(*map(module._bitmap, big)) > sum(map(len, big)) // 9  # unrelated sets are told apart


def test_allocation():
    for h, size, n in [(1, 10, 5), (50, 500, 10_000), (100, 450, 10**9), (9, 30, 10**8), (3, 6, 10**6)]:
        m, x, e = module.allocate(h, size, n)
        assert (m + x == h + 1 and e == 0 and x <= m) if x else m == h + 1 + e
    assert module.allocate(50, 500, 10_000)[1] == 0 and module.allocate(100, 450, 10**6)[2] > 1  # empty segments are left out
    assert module.allocate(3, 6, 10**6)[1] > 0  # unrelated short sets would meet in empty segments
    firsts = module.bands(5000, 90, 100)
    for k, (a, b) in enumerate(zip(firsts, firsts[1:], strict=False)):
        assert k + 2 >= len(firsts) or (b - 1) * 100 // 90 < firsts[k + 2] and a < b


def family(rng, base, edits, count):
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}" if rng.random() < 0.7 else rng.choice(base)
        out.append(" ".join(w))
    return out


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for length, edits, count in [(150, 9, 60), (60, 3, 30), (12, 1, 12), (30, 2, 25), (400, 30, 40), (9, 1, 6), (2, 0, 3)]:
        texts += family(rng, rng.choices(vocabulary, k=length), edits, count)
    base = rng.choices(vocabulary, k=200)
    texts += [" ".join(base[k : k + 120]) for k in range(0, 60, 2)]  # a chain: neighbours link, ends do not
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 80))) for _ in range(60)]
    texts += [texts[5]] * 20 + ["", "  \n", None, "A b C", "a B c", "a b", "a  b"]
    data = [(k, t, "c", k) for k, t in enumerate(rng.sample(texts, len(texts)))]
    return [*data, (7, "other text of the same id", None, 1), (None, texts[0], None, 1), (None, None, None, None), data[9], data[9]]


@pytest.mark.parametrize(("num", "den", "crowd", "most"), [(90, 100, 64, 10**6), (80, 100, 2, 0)])
def test_against_brute_force(spark, monkeypatch, num, den, crowd, most):
    monkeypatch.setattr(module, "CROWD", crowd)
    monkeypatch.setattr(module, "MOST_BROADCAST", most)
    monkeypatch.setattr(module, "MOST_PAIRS", most)
    monkeypatch.setattr(module, "PAIRWISE", 3 if most else 0)
    data = corpus()
    got = module.jaccard_components(spark.createDataFrame(data, "doc_id long, text string, cid string, n long").repartition(3), 3, num, den).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got) == brute(data, 3, num, den)


def test_frequent_passages_do_not_pair(spark, monkeypatch):
    """Unrelated documents with one passage in common met in crowded buckets, all of whose pairs were compared."""
    rng, pairs, ordinary = random.Random(8), [], module._ordinary_pairs
    passage = " ".join(f"p{k}" for k in range(40))
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(250, 300)))
    data = [(k, f"{text()} {passage} {text()}") for k in range(240)]
    data += [(k, f"{data[k - 1000][1]} another end") for k in range(1000, 1020)]

    def counting(rows, *rest):
        pairs.append(rows.groupBy("sig").count().selectExpr("sum(count * (count - 1) / 2) pairs").first().pairs or 0)
        return ordinary(rows, *rest)

    monkeypatch.setattr(module, "_ordinary_pairs", counting)
    got = module.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), 5, 80, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k % 1000 for k, _ in data}
    assert pairs[0] < 4500  # mostly of the 20 copies; 5653 with all crowded buckets


def test_least_number_of_segments():
    rng = np.random.default_rng(7)
    for num, den in ((80, 100), (90, 100)):
        first = module.bands(2000, num, den)
        schemes = {}
        for j, f in enumerate(first):
            h = 2 * ((first[j + 1] if j + 1 < len(first) else f * den // num + 1) - 1) * (den - num) // (den + num)
            if h:
                schemes[j] = module.allocate(h, f, 1000)
        for _ in range(400):
            a = np.unique(rng.integers(0, 1 << 60, rng.integers(12, 900)).astype(np.uint64))
            b = a
            while module._linked(a, c := np.unique(np.append(np.delete(b, rng.integers(len(b))), rng.integers(0, 1 << 60, rng.integers(0, 3)).astype(np.uint64))), num, den):
                b = c
            band = [int(np.searchsorted(first, len(s), "right")) - 1 for s in (a, b)]
            for scheme in (max(band), max(band) + 1):
                if scheme in schemes and all(scheme == j or len(s) * den // num >= first[scheme] for s, j in zip((a, b), band, strict=True)):
                    met = len(np.intersect1d(module._signatures(a, scheme, *schemes[scheme]), module._signatures(b, scheme, *schemes[scheme])))
                    assert met >= max(module.least_met(len(s), scheme, first, schemes, num, den) for s in (a, b))


def test_no_documents(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert module.jaccard_components(frame).collect() == []
    one = spark.createDataFrame([(4, None), (5, "")], "doc_id long, text string")
    assert sorted(map(tuple, module.jaccard_components(one).collect())) == [(4, 0, 4), (5, 0, 5)]


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components_module, "FEW", few)
    rng = random.Random(5)
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {n: n for p in pairs for n in p}
    for _ in range(300):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if any(a != b for a, b in pairs if n in (a, b))}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
