"""The pipeline's rows against each stage written out plainly."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from strataline.llm import quality_classifier
from tests.llm import fixtures
from tests.llm.test_documents import brute_components
from tests.llm.test_pages_and_models import brute_leaks, brute_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score2 double, root string, key string"


def write(spark, folder, docs, labels, items):
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "r", "k") for i, t in docs], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def redacted(text):
    out, at = [], 0
    for s in brute_spans(text or ""):
        kind, a, b = s.split(":")
        if int(a) >= at:
            out += [text[at : int(a)], f"<{kind.upper()}>"]
        at = max(at, int(b))
    return "".join([*out, text[at:]]) if text is not None else None


def brute(spark, folder, docs, items):
    weights = quality_classifier.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))

    def score(text):
        index, values = quality_classifier.features(text)
        return 1 / (1 + np.exp(-sum(float(weights[i]) * v for i, v in zip(index.tolist(), values.tolist(), strict=True)) - float(weights[-1])))

    good = [(i, t) for i, t in docs if score(t) >= 0.3]
    # Of each component the smallest id stays, once; what has no words stays row by row.
    component = {(i, n): c for i, n, c in brute_components(good, 5, 80)}
    words = lambda t: len((t or "").split())
    size = lambda t: max(1, words(t) - 4) if words(t) else 0
    distinct, seen = [], set()
    for i, t in good:
        if not words(t):
            distinct.append((i, t))
            continue
        own = next(c for (j, n), c in component.items() if j == i and c is not None and (n > 0))
        if own == i and i not in seen:
            seen.add(i)
            distinct.append((i, t))
    assert all(size(t) >= 0 for _, t in distinct)
    leaked = {d for d, _, _ in brute_leaks(distinct, items)}
    clean = [(i, redacted(t)) for i, t in distinct if i not in leaked]
    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for i, t in clean:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at, length = 0, (len(ids) - 1) % 2048 + 1
        for k in range(-(-len(ids) // 2048)):
            out[(i, k, at, length, zlib.crc32(ids[at : at + length].tobytes()))] += 1
            at, length = at + length, 2048
    return out


def test_pipeline_equals_its_stages_written_out(spark, tmp_path):
    r = random.Random(21)
    docs = [(k, fixtures.words(r, 80)) for k in range(70)]
    labels = [(k, 1, 0) for k in range(70)]
    for k in range(100, 170):
        docs.append((k, " ".join(w + "***" for w in fixtures.words(r, 80).split())))
        labels.append((k, 0, 0))
    items = [(1, fixtures.words(r, 30)), (2, fixtures.words(r, 45)), (3, None)]
    for k in range(10):
        changed = docs[k][1].split()
        changed[r.randrange(80)] = "new"
        docs.append((200 + k, " ".join(changed)))
    docs += [(220, docs[30][1]), (221, docs[31][1].upper()), (30, docs[30][1])]
    docs += [(230 + k, f"{fixtures.words(r, 50)} {items[k % 2][1]} {fixtures.words(r, 50)}") for k in range(6)]
    docs += [(240 + k, f"{fixtures.words(r, 60)} {x}") for k, x in enumerate(("mail a.b@c.de now", "10.1.2.3 and 4111 1111 1111 1111", "+48 123 456 789 12", "nothing 12"))]
    docs += [(250, None), (251, ""), (252, " \n "), (253, fixtures.words(r, 6000))]
    write(spark, tmp_path, docs, labels, items)
    got = Counter(tuple(x)[:5] for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = brute(spark, tmp_path, docs, items)
    assert got == want
    ids = {k[0] for k in want}
    assert set(range(70)) <= ids and not ids & set(range(100, 170)) and not ids & {*range(200, 210), 220, 221, *range(230, 236)} and {240, 243, 253} <= ids


@pytest.mark.parametrize("empty", ["documents", "all"])
def test_pipeline_of_empty_tables(spark, tmp_path, empty):
    write(spark, tmp_path, [], [] if empty == "all" else [(1, 1, 0)], [] if empty == "all" else [(1, "some text of a benchmark item")])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_the_columns(spark, tmp_path):
    docs = [(1, "one two three"), (1, "one two three"), (None, "four five"), (2, None)]
    write(spark, tmp_path, docs, [], [(1, "a benchmark item of some words")])
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns and not re.search("_", out.columns[1]), name
        assert {(x.doc_id, x.text) for x in out.collect()} == set(docs)
