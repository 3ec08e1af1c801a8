import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from batchplan.llm.packing import pack, plan_packing
from batchplan.llm.token_counts import token_counts
from batchplan.llm.token_output import read_manifest, read_token_store, write_token_store
from batchplan.llm.tokens import TextEncoder, in_blocks, vocabulary

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
EDGE = ["", " ", "\n", "a", "A b", " a", "a ", "a  b", "a\nb", "a \nb", "a\n b", "\n\na\n\n", "don't we'LL 'S's", "x\x1cy z", "a\tb\r\nc", "é É e\u0301 ß İ ΑΣ ς", "日本語 テキスト 😀👍🏽", "<|endoftext|>", "a<|startoftext|> b", "² ½ Ⅷ ٣ 3 33", "a\u00a0b\u3000c", "foo.bar,baz!?(x)", "$$$ &&&x", "\ufeffx", "a\u200bb", "x" * 3000, ("word " * 3000).strip()]
ROWS = "doc_id long, text string, id string, shard int"


@pytest.fixture(scope="module", params=[WORD, BYTE])
def pair(request):
    return TextEncoder(request.param), Tokenizer.from_file(request.param)


def same(pair, texts):
    own, library = pair
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    flat, n = own.encode_many(texts)
    assert n.tolist() == [len(w) for w in want]
    assert flat.tolist() == [i for w in want for i in w]
    assert [own.count(t) for t in texts] == n.tolist()


def test_edge_texts(pair):
    same(pair, EDGE)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(" \n\t'sSéÉßa1²$.-", max_size=40)), max_size=5))
def test_any_text(pair, texts):
    same(pair, texts)


def test_table_starts_again(pair):
    own, library = pair
    small = TextEncoder(WORD, max_units=3)
    for t in ("a b c d e f", "g h i j k", "a b z"):
        assert small.encode_many([t])[0].tolist() == Tokenizer.from_file(WORD).encode(t, add_special_tokens=False).ids


def test_blocks():
    assert list(in_blocks(["aaaa", None, "b", "cc"], 3)) == [(0, 1), (1, 4)]
    assert list(in_blocks([])) == []


def rows(spark):
    data = [(k, t, "clash", 7) for k, t in enumerate(EDGE)]
    return [*data, (3, None, None, None), data[4], data[4], (None, "no id", None, None)]


def test_token_counts(spark):
    data = rows(spark)
    got = token_counts(spark.createDataFrame(data, ROWS), WORD, limit=10).collect()
    library = Tokenizer.from_file(WORD)
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 10) for d, t, *_ in data]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_counts(spark.createDataFrame([], ROWS), WORD).collect() == []


@pytest.mark.parametrize("width", [None, 4])
def test_token_store(spark, width):
    data = rows(spark)
    uri, lines = write_token_store(spark.createDataFrame(data, ROWS), WORD, 2, width=width)
    assert read_manifest(uri)["width"] == (width or 2)
    got = sorted(read_token_store(spark, uri, with_ids=True).collect(), key=lambda r: r.start)
    library, at, last = Tokenizer.from_file(WORD), 0, -1
    want = sorted((d if d is not None else -1, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, *_ in data)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in got) == want
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
        d = -1 if r.doc_id is None else r.doc_id
        assert d >= last
        last = d
    assert sum(x["n_ids"] for x in lines) == at
    uri, lines = write_token_store(spark.createDataFrame([], ROWS), WORD, 2)
    assert lines == [] and read_token_store(spark, uri).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 9), max_size=12))
def test_plan(counts):
    plan = plan_packing(counts, 24)
    used = {}
    for pattern, times in plan:
        assert sum(pattern) <= 24 and times > 0
        for n in pattern:
            used[n] = used.get(n, 0) + times
    assert used == counts
    total = sum(n * k for n, k in counts.items())
    assert sum(t for _, t in plan) <= max(1, 2 * total / 24 + 1) if counts else not plan


def test_plan_fills_gaps():
    assert sum(t for _, t in plan_packing({9: 1, 1: 1, 6: 1, 3: 1, 4: 1, 7: 1}, 10)) == 3
    assert plan_packing({5: 4}, 10) == [((5, 5), 2)]
    with pytest.raises(ValueError):
        plan_packing({11: 1}, 10)


def test_pack(spark):
    data = rows(spark)
    got = pack(spark.createDataFrame(data, ROWS), BYTE, 0, 64).collect()
    library = Tokenizer.from_file(BYTE)
    pieces = {}
    for d, t, *_ in data:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids), 64), len(ids)]
        for k, (a, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            key = (d, k, a, e - a, zlib.crc32(np.array(ids[a:e], "<u4").tobytes()))
            pieces[key] = pieces.get(key, 0) + 1
    found = {}
    for r in got:
        found[tuple(r)[:5]] = found.get(tuple(r)[:5], 0) + 1
    assert found == pieces
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= sum(r.length for r in got) / 64 * 1.1 + 2
    assert pack(spark.createDataFrame([], ROWS), BYTE, 0, 64).collect() == []


def test_workers_drop_what_others_handed_on():
    import pyarrow as pa

    from batchplan.llm import tokens
    from batchplan.llm.spark_io import freeing

    path = vocabulary("byte_bpe_50k.json")
    batch = pa.record_batch([pa.array([1])], names=["x"])
    own = tokens.encoder(path)
    assert list(freeing(lambda b: b, hands_on=True)(iter([batch]))) == [batch] and tokens.encoder(path) is own
    assert list(freeing(lambda b: b)(iter([batch]))) == [batch] and tokens.encoder(path) is not own


def test_nothing_is_merged_twice():
    """Not a word beside a comma, nor a unit of the last table."""
    own, library, asked = TextEncoder(BYTE, max_units=3), Tokenizer.from_file(BYTE), []
    merge = own.tokenize
    own.tokenize = lambda pretoken: asked.append(pretoken) or merge(pretoken)
    for t in ("so alpha, alpha. alpha%% é", "so beta alpha é, gamma", "so beta", "so delta beta,"):
        assert own.encode_many([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids
    words = [p for p in asked if p[0] == "Ġ"]
    assert words and len(words) == len(set(words))
