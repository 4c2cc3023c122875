"""WARC, URL filters, PII, classifier, decontamination and the pipeline against brute force."""

import hashlib
import io
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from strataline.llm import boosting, decontamination, pii, quality_classifier, url_filter, warc
from tests.llm import fixtures

PAGES = "page_id long, url string, html string, n long, last boolean, key string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, True, "k") for r in rows], PAGES)


PAGE_ROWS = [
    (1, "http://a.org/x", None), (2, None, ""), (3, "x y\r\nz", "b" * 999), (4, "http://b.com/", "b" * 999), (5, "u", "c" * 1000), (6, "u", "c" * 1000),
    (7, "u", "c" * 1000), (8, "u", "ž" * 500_000), (9, "u", "line\r\n\r\nWARC/1.1\r\n" * 100), (9, "u", "line\r\n\r\nWARC/1.1\r\n" * 100), (None, "u", "c" * 1000), (10, "u", "\x00\x01é"),
]


def test_warc_round_trip(spark):
    got = Counter(map(tuple, warc.round_trip(pages(spark, PAGE_ROWS)).collect()))
    last = {}
    for i, _, h in PAGE_ROWS:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    want = Counter()
    for i, _, h in PAGE_ROWS:
        b = (h or "").encode()
        revisit = i is not None and len(b) >= 1000 and i < last[h or ""]
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", last[h or ""] if revisit else None)] += 1
    assert got == want
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_a_revisit_must_have_its_response(spark):
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    rows = [(2, 5, "aa", "response", None), (2, 7, "bb", "response", None), (1, 5, "aa", "revisit", 2), (3, 7, "bb", "revisit", 2)]
    assert Counter(map(tuple, warc.with_checked_revisits(spark.createDataFrame(rows, schema)).collect())) == Counter(rows)
    for bad in ((4, 5, "bb", "revisit", 2), (4, 5, "aa", "revisit", 9)):
        with pytest.raises(Exception, match="no response"):
            warc.with_checked_revisits(spark.createDataFrame([*rows, bad], schema)).collect()


def test_chunked_record_table(spark):
    chunks = warc.read_archives(warc.write_archives(pages(spark, PAGE_ROWS))).collect()
    whole = {}
    for c in sorted((c for c in chunks if c.record_type == "response" and c.page_id is not None), key=lambda c: c.chunk):
        whole.setdefault((c.page_id, c.record_id), []).append(c)
    big = next(v for k, v in whole.items() if k[0] == 8)
    assert len(big) == -(-1_000_000 // warc.CHUNK_BYTES) and b"".join(c.data for c in big) == ("ž" * 500_000).encode()
    assert [c.digest for c in big] == [hashlib.sha1(("ž" * 500_000).encode()[: c.payload_bytes]).hexdigest() for c in big]


def test_damaged_archives_are_told(spark):
    out = io.BytesIO()
    warc.write_record(out, 1, "u", memoryview(b"payload"), None)
    data = zlib.decompress(out.getvalue(), 31)
    bad = data.replace(b"payload", b"pAyload")
    packed = lambda b: (lambda c: c.compress(b) + c.flush())(zlib.compressobj(1, zlib.DEFLATED, 31))
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(packed(bad)), "a"))
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_records(io.BytesIO(packed(data[:-9])), "a"))


def brute_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h), len(p), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_url_filter(spark):
    hosts = ["example.org", "EXAMPLE.org", "a.b.example.org", "notexample.org", "x.com", "com", "org", "example.org:80", "É.org", "x.net", "", "org."]
    paths = ["", "/", "/es/", "/es", "/es/x", "/en/1", "/en/12/3", "/en/2", "/fr/", "/de/x?/fr/", "?/fr/", "#/de/", "/de/#x", "//es/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "example.org/es/", "a://b://example.org/es/"]
    got = {r.page_id: tuple(r)[1:] for r in url_filter.url_verdicts(pages(spark, [(k, u, "") for k, u in enumerate(urls)])).collect()}
    assert got == {k: brute_verdict(u) for k, u in enumerate(urls)}
    assert url_filter.url_verdicts(pages(spark, [])).collect() == []
    with pytest.raises(ValueError):
        url_filter.build_trie([("block", "a.b", "x")])
    with pytest.raises(ValueError, match="named host"):
        url_filter.url_verdicts(pages(spark, []).withColumnRenamed("page_id", "host"), key="host")
    many = url_filter.build_trie([("block", "a.b", f"/{'x' * (k % 9)}{k}") for k in range(5000)] + [("allow", "a.b", "/")])
    assert url_filter.longest_match(many, "w.a.b", "/xxxx4") == ("a.b/xxxx4", "block") and url_filter.longest_match(many, "a.b", "/xxxxx") == ("a.b/", "allow")
    assert len(many.labels["b"].labels["a"].segments[""].lengths) < 20
    long = "http://example.org/" + "es/" * 200_000
    assert [tuple(r)[3:] for r in url_filter.url_verdicts(pages(spark, [(1, long, "")])).collect()] == [("example.org/es/", "block")]
    both = url_filter.build_trie([("allow", "a.b", "/x"), ("block", "a.b", "/x")])
    assert url_filter.longest_match(both, "a.b", "/x/y") == ("a.b/x", "block")


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn_sum(digits) % 10 == 0) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return [f"{list(BASE)[k]}:{a}:{b}" for a, k, b in sorted(out)]


PII_TEXTS = [
    None, "", "a@b.cd@e.fg", "a@b.c.d%x@y.z", "1 " * 3000, "9" * 50_000, "+1 2 3" * 2000, "1.2.3.4.5.6.7.8", "0000001.2.3.004", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 5",
    "+1 (826) 555-4081 226.7.1.2", "4465758382889437 4465758382889437", "ü😀 4111111111111111 é@x.y a@b.c", "john (at) mail (dot) com", "a." * 20_000 + "@x.y", "99999999999999999999.1.1.1", "x\n+1 743 555 3824.\n",
]


def test_pii(spark):
    df = fixtures.frame(spark, list(enumerate(PII_TEXTS)))
    got = {r.doc_id: r for r in pii.spans_report(df).collect()}
    for k, t in enumerate(PII_TEXTS):
        spans = brute_spans(t or "")
        assert got[k].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), t[:50]
        assert [got[k][f"n_{n}"] for n in pii.KINDS] == [sum(s.startswith(n) for s in spans) for n in pii.KINDS]
        assert set(spans) <= set(got[k].spans.split(",")) | {""}
    assert got[12].spans == "phone:0:17,ip:18:27" and got[13].spans == "card:0:16,card:17:33" and got[15].spans.startswith("email:0:")
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[12] == "<PHONE> <IP>" and clean[13] == "<CARD> <CARD>" and clean[14].endswith("<EMAIL>") and clean[0] is None and clean[17] == PII_TEXTS[17]
    assert pii.redact(df).columns == df.columns and pii.spans_report(fixtures.empty(spark)).collect() == []


def test_pii_phones_in_small_groups(spark):
    texts = ["call +33 6 12 34 56 78 now", "+12 34 56 78 90", "+1....2....3....4....5....6....7....8....9....0", "+1234567890", "+12 34 56 78 9", "+ 12 34 56 78 90"]
    df = fixtures.frame(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in pii.spans_report(df).collect()}
    for k, t in enumerate(texts):
        spans = brute_spans(t)
        assert got[k].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and got[k].n_phone == len(spans) == (k < 4), t
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[0] == "call <PHONE> now"


def test_pii_clashes_and_long_parts(spark):
    for name, work in (("_spans", pii.with_spans), ("_pii", pii.redact)):
        with pytest.raises(ValueError, match=name):
            work(fixtures.empty(spark).withColumnRenamed("cls", name))
    texts = [f"write {'a' * 200} (at) {'b' * 100} (dot) {'c' * 40} now", "x" * 300_000 + " (at) " + "y" * 300_000]
    got = {r.doc_id: r.spans for r in pii.spans_report(fixtures.frame(spark, list(enumerate(texts)))).collect()}
    assert got == {0: "email:6:359", 1: ""}


@pytest.mark.parametrize("seed", range(2))
def test_base_spans_of_random_texts(spark, seed):
    """Base spans against the patterns themselves, on texts made of the letters that matter to them."""
    import random

    r = random.Random(seed)
    letters = "0123456789" * 3 + "+++..--  ()@@ab\n"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["+" + (r.choice(" .-()") * r.randint(0, 6)).join(r.choice("0123456789") for _ in range(r.randint(8, 16))) for _ in range(500)]
    for x in pii.spans_report(fixtures.frame(spark, list(enumerate(texts)))).collect():
        assert x.base_sha256 == hashlib.sha256(",".join(brute_spans(texts[x.doc_id])).encode()).hexdigest(), texts[x.doc_id]


def test_pii_features_in_sql_and_python(spark):
    from pyspark.sql import functions as F

    text = "tel (743) 555-3824, card 4111 1111 1111 1111. mail x (at) y (dot) com; version 10.20.30.40"
    for kind, pattern in pii.GENERATORS:
        rows = spark.range(1).select(F.lit(text).alias("t")).select(F.explode(pii.found(F.col("t"), kind, pattern, lambda s: F.lit(True))).alias("c"), "t").select("c.*", pii.features_sql(F.col("c"), F.col("t")).alias("f")).collect()
        assert rows
        for r in rows:
            assert list(r.f) == pii.features(kind, r.span, text[max(0, r.start - pii.CONTEXT) : r.start], text[r.end :])


def test_boosting_learns():
    x = np.array([[a, b] for a in range(10) for b in range(10)] * 5)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 6)).astype(int)
    trees = boosting.boost(x, y)
    assert ((boosting.total(trees, x) > 0) == y).mean() > 0.98
    assert boosting.threshold(np.array([3.0, 2.0, 1.0]), np.array([1, 1, 0]), 0.9) == 2.0 and boosting.threshold(np.array([1.0]), np.array([0]), 0.9) == float("inf")


def test_classifier(spark):
    import random

    r = random.Random(1)
    rows, labels = [], []
    for k in range(600):
        good = k % 3 > 0
        text = fixtures.words(r, 60)
        rows.append((k, text if good else " ".join(w + "***" for w in text.split())))
        labels.append((k, int(good), 0))
    labels += [(1, None, 0), (None, 1, 0), (9999, 1, 0)]
    rows += [(700, None), (701, ""), (0, "again"), (None, "no id"), (702, fixtures.words(r, 50_000))]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_scores(fixtures.frame(spark, rows), known).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 and g.held_out == (g.doc_id is None or zlib.crc32(str(g.doc_id).encode()) % 5 == 0) and g.predicted == int(g.score >= 0.3) for g in got)
    held = [(g.predicted, int(g.doc_id % 3 > 0)) for g in got if g.held_out and g.doc_id and g.doc_id < 600]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    kept = quality_classifier.keep_good(fixtures.frame(spark, rows), known)
    assert kept.columns == fixtures.frame(spark, rows).columns and kept.count() == sum(g.predicted for g in got)
    nothing = quality_classifier.quality_scores(fixtures.frame(spark, rows[:3]), known.limit(0)).collect()
    assert [g.score for g in nothing] == [0.5] * 3
    assert quality_classifier.quality_scores(fixtures.empty(spark), known).collect() == []


def brute_leaks(docs, items):
    split = lambda t: re.sub(r"[^\w]+|_", " ", (t or "").lower()).split()
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    out = set()
    for d, t in docs:
        words = split(t)
        for i, x in items:
            item = split(x)
            if not item or not words:
                continue
            for start in range(len(words)):
                here, there = grams(words[start : start + len(item)]), grams(item)
                if 100 * sum((here & there).values()) >= 80 * sum((here | there).values()):
                    out.add((d, i, start))
    return out


def test_classifier_equals_a_plain_one():
    """Features and updates against FTRL-proximal written out weight by weight."""
    import random

    r = random.Random(2)
    texts = [fixtures.words(r, n) for n in (0, 1, 2, 5, 30, 60)] + ["a b c " * 20]
    examples = [(np.append(i, 1 << quality_classifier.BITS), np.append(v, 1.0), k % 2) for k, (i, v) in enumerate(map(quality_classifier.features, texts))]
    q = quality_classifier
    z, n, order = Counter(), Counter(), [np.random.default_rng(e).permutation(len(examples)) for e in range(q.EPOCHS)]

    def weight(i):
        return 0.0 if abs(z[i]) <= q.L1 else -(z[i] - np.sign(z[i]) * q.L1) / ((q.BETA + n[i] ** 0.5) / q.ALPHA + q.L2)

    for epoch in order:
        for k in epoch:
            index, values, label = examples[k]
            w = {i: weight(i) for i in index.tolist()}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(index.tolist(), values.tolist(), strict=True))))
            for i, v in zip(index.tolist(), values.tolist(), strict=True):
                g = (p - label) * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / q.ALPHA * w[i]
                n[i] += g * g
    learned = q.train(examples)
    for i in range(len(learned)):
        if i in z:
            assert abs(learned[i] - weight(i)) < 1e-5
    assert np.count_nonzero(learned) == sum(weight(i) != 0 for i in list(z))


def test_training_rows_are_bounded(spark):
    rows = [(1, f"text {k}") for k in range(50)] + [(2, "other")]
    known = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.fit(fixtures.frame(spark, rows), known, train_rows=1) is not None
    weights = quality_classifier.fit(fixtures.frame(spark, rows), known, train_rows=2)
    assert weights is not None and len(weights) == (1 << quality_classifier.BITS) + 1


def test_decontamination(spark):
    import random

    r = random.Random(5)
    items = [(k, fixtures.words(r, n)) for k, n in enumerate((14, 30, 55, 90))] + [(7, None), (8, "a b"), (9, "")]
    docs = [(k, f"{fixtures.words(r, 50)} {items[k % 4][1]} {fixtures.words(r, 40)}") for k in range(8)]
    docs += [(20, items[0][1].upper().replace(" ", ",\n")), (21, fixtures.words(r, 300)), (22, None), (23, ""), (24, "a b"), (25, " ".join(items[3][1].split()[:88]) + " other words"), (26, items[1][1]), (26, items[1][1])]
    got = decontamination.leaks(fixtures.frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_leaks(docs, items)
    assert {(g.doc_id, g.item_id, g.start) for g in got} == want
    assert all(0.8 <= g.similarity <= 1 and g.distance <= decontamination.RADIUS for g in got)
    left = decontamination.without_leaks(fixtures.frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(x.doc_id for x in left.collect()) == [21, 22, 23] and left.columns == fixtures.frame(spark, docs).columns
    assert decontamination.leaks(fixtures.empty(spark), spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_short_items_inside_longer_documents(spark):
    items = [(1, "Quick"), (2, "brown fox"), (3, "the lazy dog"), (4, "one two three four"), (5, "one two three four five")]
    docs = [(1, "the quick brown fox, jumps over the lazy dog"), (2, "quick"), (3, "brown; Fox"), (4, "so one two three four"), (5, "x one two three four five y"), (6, "brown dog fox"), (7, None)]
    got = decontamination.leaks(fixtures.frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(g.doc_id, g.item_id, g.start) for g in got} == brute_leaks(docs, items) and {g.similarity for g in got} == {1.0}
    assert {(g.doc_id, g.item_id) for g in got} >= {(1, 1), (1, 2), (1, 3), (4, 4), (5, 4), (5, 5)}


def test_permuted_and_cut_passages(spark):
    """Halves that change places, words that change, passages at a document's end: windows at any start."""
    import random

    r, items, docs = random.Random(12), [], []
    for k in range(30):
        words = fixtures.words(r, 60).split()
        items.append((k, " ".join(words)))
        half = r.choice([20, 30, 40])
        docs.append((3 * k, f"{fixtures.words(r, 40)} {' '.join(words[half:] + words[:half])} {fixtures.words(r, 30)}"))
        changed = list(words)
        changed[r.randrange(60)] = "changed"
        docs.append((3 * k + 1, f"{fixtures.words(r, 20)} {' '.join(changed)}"))
        docs.append((3 * k + 2, f"{fixtures.words(r, 20)} {' '.join(words[: r.choice([50, 54, 58])])}"))
    got = decontamination.leaks(fixtures.frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_leaks(docs, items)
    found = {(g.doc_id, g.item_id, g.start) for g in got}
    assert found <= want and len(found) >= 0.98 * len(want) and {(d, i) for d, i, _ in found} == {(d, i) for d, i, _ in want}
    assert {d // 3 for d, *_ in want if d % 3 == 0} == set(range(30))


def test_fingerprints(spark):
    """SimHashes and feature sets against plain ones; in few and in many counters the same."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    rows = [([int(x) for x in rng.integers(-(2**63), 2**63 - 1, n)],) for n in (1, 2, 33, 400)] + [([5, 7, 5, 5],)]
    df = spark.createDataFrame(rows, "g array<long>").select("g", decontamination.features(F.col("g")).alias("f")).withColumn("s", decontamination.simhash(F.col("f")))
    for g, f, s in map(tuple, df.collect()):
        assert len(set(f)) == len(g) and set(g) <= set(f)
        want = sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in f) > len(f))
        assert s % 2**64 == want
    few = [r.s for r in df.collect()]
    old, decontamination.LANE = decontamination.LANE, 0
    try:
        assert [r.s for r in df.select(decontamination.simhash(F.col("f")).alias("s")).collect()] == few
    finally:
        decontamination.LANE = old


def test_weighted_borderline_pairs(spark):
    """Similarity 0.8 by one shingle that is counted often: its occurrences are features of their own."""
    import random

    r, items, docs = random.Random(9), [], []
    for k in range(40):
        words = fixtures.words(r, 40)
        items.append((k, words + " ba" * 14))
        docs.append((k, words + " ba" * 4))
    got = decontamination.leaks(fixtures.frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_leaks(docs, items)
    assert {(g.doc_id, g.item_id) for g in got} == {(d, i) for d, i, _ in want} == {(k, k) for k in range(40)}


def test_blocks_find_all_within_the_radius(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    rows = []
    for _ in range(200):
        a = int(rng.integers(-(2**63), 2**63 - 1))
        b = a
        for bit in rng.permutation(64)[: int(rng.integers(0, decontamination.RADIUS + 1))]:
            b ^= int(np.uint64(1) << np.uint64(bit)) if bit < 63 else -(2**63)
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a long, b long")
    shared = F.size(F.array_intersect(decontamination.blocks(F.col("a")), decontamination.blocks(F.col("b"))))
    assert df.where(shared == 0).isEmpty()


def test_pipeline_stages(spark, tmp_path):
    import random

    r = random.Random(11)
    docs = [(k, fixtures.words(r, 80), "en", "s", 0) for k in range(60)]
    docs += [(100 + k, " ".join(w + "***" for w in fixtures.words(r, 80).split()), "en", "s", 0) for k in range(60)]
    item = fixtures.words(r, 30)
    docs += [(200, docs[0][1], "en", "s", 0), (201, fixtures.words(r, 60) + " " + item, "en", "s", 0), (202, fixtures.words(r, 70) + " a.b@c.de", "en", "s", 0), (203, None, "en", "s", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], int(d[0] < 100), 0) for d in docs[:120]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns, name
        out.write.parquet(f"{tmp_path}/{name}.parquet")
        table = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        kept.append({x.doc_id: x for x in table.collect()})
    assert set(range(60)) <= set(kept[0]) and not set(range(100, 160)) & set(kept[0])
    assert 0 in kept[1] and 200 not in kept[1] and 201 in kept[1] and 201 not in kept[2] and set(range(60)) <= set(kept[2])
    assert kept[3][202].text.endswith(" <EMAIL>") and kept[3][202].n_chars == len(kept[3][202].text) and set(kept[3]) == set(kept[2])
