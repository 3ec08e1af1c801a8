import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from batchplan.llm import catalog
from batchplan.llm.tokens import vocabulary
from test_decontaminate import brute as contaminated
from test_jaccard_join import brute_set
from test_pii import brute as personal


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d, rng = str(tmp_path_factory.mktemp("tables")), random.Random(6)
    vocabulary_ = [f"{a}{b}{c}" for a in ("th", "st", "on", "er") for b in ("a", "e", "i", "o") for c in ("nd", "ly", "ng", "t")]
    prose = lambda n: " ".join(rng.choices(vocabulary_, k=n))
    contact = lambda k: f" me{k}@corp.example {prose(5)} +49 (30) 1234567{k % 10}" if k % 4 == 0 else ""
    docs = [(k, prose(rng.randint(30, 90)) + contact(k)) for k in range(120)]  # trusted text has personal data too
    items = [(k, prose(14)) for k in range(5)]
    docs += [(200 + k, docs[k][1]) for k in range(6)] + [(210 + k, docs[k][1] + " thand") for k in range(6)]
    docs += [(220 + k, f"{prose(20)} {items[k][1].upper()} {prose(20)}") for k in range(5)]
    docs += [(230 + k, f"{prose(30)} me{k}@corp.example {prose(5)} +49 (30) 1234567{k} {prose(30)}") for k in range(5)]
    docs += [(240 + k, "".join(chr(rng.randint(33, 90)) for _ in range(200))) for k in range(5)]
    docs += [(250, None), (251, ""), (252, docs[40][1]), (252, prose(40)), (253, docs[41][1]), (253, docs[41][1])]
    table(spark, d, "documents", [(k, t, "en", "s", len(t or "")) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    table(spark, d, "labels", [(k, 1, 0) for k in range(0, 120)] + [(240, 0, 0)], "doc_id long, quality int, toxic int")
    table(spark, d, "benchmark", items, "item_id long, text string")
    return d, docs, items


def test_stages(spark, folder, tmp_path):
    d, docs, items = folder
    frame, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, frame, d).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        assert frame.columns == columns
        seen[name] = sorted((r.doc_id, r.text) for r in frame.collect())
    good = seen["quality_classifier"]
    wanted = sorted((k, t) for k, t in docs if t and not 240 <= k < 250)
    assert (set(wanted) - set(good), set(good) - set(wanted), len(good)) == (set(), set(), len(wanted))

    root = list(range(len(good)))
    find = lambda i: i if root[i] == i else find(root[i])
    sets = [brute_set(t, 5) for _, t in good]
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, row in enumerate(good):
        groups.setdefault(find(i), []).append(row)
    one = seen["jaccard_join"]
    assert len(one) == len(groups) < len(good) and all(sum(one.count(r) for r in set(g)) == 1 for g in groups.values())

    clean = seen["decontamination"]
    assert clean == [r for r in one if not contaminated(r[1], items, 10)[-1]] and len(clean) <= len(one) - 5

    before = dict(clean)
    for k, text in seen["personal_data"]:
        assert not any(personal(text).values())
        if not any(personal(before[k]).values()) and k != 252:
            assert text == before[k]
    assert len(seen["personal_data"]) == len(clean)

    packed = corpus_pipeline.STAGES[-1][1](spark, frame, d).collect()
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = sorted((k, zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())) for k, t in seen["personal_data"])
    assert sorted((r.doc_id, r.ids_crc32) for r in packed) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).select("doc_id", "ids_crc32").collect())) == want
    assert not any(re.search(r"[\w.]+@", t) for _, t in seen["personal_data"])


def test_empty_tables(spark, folder, tmp_path):
    d, *_ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered():
    names = list(catalog.queries())
    assert [re.match(r"op(\d+)_", n)[1] for n in names] == [str(k) for k in range(1, 11)]
