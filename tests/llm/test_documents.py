"""Operators over documents against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataline.llm import jaccard_join, quality_rules, suffix_dedup, suffix_sort
from tests.llm import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def metrics(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    rows = fixtures.texts()
    got = quality_rules.quality_report(fixtures.frame(spark, rows)).collect()
    want = Counter()
    for i, t in rows:
        m = metrics(t)
        want[(i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)
    assert quality_rules.quality_report(fixtures.empty(spark)).collect() == []


def test_cascade_order_changes_no_verdict(spark):
    df = fixtures.frame(spark, fixtures.texts())
    verdicts = []
    for rules in (quality_rules.BASE_RULES + quality_rules.RULES, tuple(reversed(quality_rules.BASE_RULES + quality_rules.RULES))):
        metric = lambda name: quality_rules.METRICS[name](quality_rules.F.coalesce("text", quality_rules.F.lit("")))
        verdicts.append(Counter(map(tuple, df.select("doc_id", quality_rules.cascade(rules, metric).isNull()).collect())))
    applied = quality_rules.apply_rules(df)
    assert verdicts[0] == verdicts[1] == Counter((r.doc_id, r.rejected_by is None) for r in applied.select("doc_id", "rejected_by").collect())
    rules = quality_rules.RULES[:3]  # symbols, duplicate_lines, shouting
    assert [quality_rules.needs(r) for r in rules] == [["n_symbols", "n_words"], ["n_dup_lines", "n_lines"], ["n_upper", "word_chars"]]
    found = {"costs": {"n_symbols": 1, "n_words": 1, "n_dup_lines": 1, "n_lines": 1, "n_upper": 0.5, "word_chars": 0.5}, "needs": {r.name: quality_rules.needs(r) for r in rules}}
    names = lambda patterns, known=(): [r.name for r in quality_rules.ordered(rules, found | {"patterns": patterns}, known)]
    assert names([((True, False, False), 10), ((False, True, False), 9), ((False, False, True), 6)]) == ["shouting", "symbols", "duplicate_lines"]
    # What an earlier rule rejects no longer counts, and what is computed anyway costs nothing.
    assert names([((True, True, False), 10), ((False, False, True), 1)]) == ["symbols", "shouting", "duplicate_lines"]
    assert names([((True, False, False), 2), ((False, True, False), 9)], ["n_symbols", "n_words"]) == ["symbols", "duplicate_lines", "shouting"]
    measured = quality_rules.estimate(df, "text", quality_rules.RULES)
    assert sum(n for _, n in measured["patterns"]) == len(fixtures.texts()) and all(s >= 0 for s in measured["costs"].values())
    with pytest.raises(ValueError):
        quality_rules.apply_rules(applied)


def brute_components(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = Counter()
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            out[(rows[i][0], len(sets[i]), (min(ids) if ids else None) if sets[i] else rows[i][0])] += 1
    return out


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(spark, words, percent):
    rows = fixtures.texts()
    got = jaccard_join.near_duplicates(fixtures.frame(spark, rows), words, percent).collect()
    assert Counter(map(tuple, got)) == brute_components(rows, words, percent)


def test_jaccard_families_and_empty(spark):
    """Near copies that link by steps: only a chain holds some families together."""
    import random

    r = random.Random(3)
    rows, n = [], 0
    for _ in range(6):
        text = fixtures.words(r, 100).split()
        for _ in range(25):
            text = list(text)
            for _ in range(r.randint(0, 2)):
                text[r.randrange(len(text))] = f"new{n}"
            rows.append((n, " ".join(text)))
            n += 1
    got = jaccard_join.near_duplicates(fixtures.frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == brute_components(rows, 3, 90)
    assert jaccard_join.near_duplicates(fixtures.empty(spark)).collect() == []


def test_jaccard_outliers_of_a_family(spark):
    """Lightly and heavily changed copies of one text: many components that share tokens, most pairs just under the threshold."""
    import random

    r = random.Random(5)
    base = fixtures.words(r, 120).split()
    rows = []
    for n in range(400):
        text, changes = list(base), r.choice([1, 1, 2, 3, 5, 6, 7, 8, 12])
        for k in r.sample(range(len(text)), changes):
            text[k] = f"new{r.randrange(60)}" if r.random() < 0.7 else ""
        rows.append((n, " ".join(w for w in text if w)))
    got = jaccard_join.near_duplicates(fixtures.frame(spark, rows), 5, 80).collect()
    want = brute_components(rows, 5, 80)
    assert Counter(map(tuple, got)) == want
    assert len({c for _, _, c in want}) > 20


def brute_links(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    linked = [sum(i != j and bool(a and b) and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    return Counter((i, len(s), n) for (i, _), s, n in zip(rows, sets, linked, strict=True))


@pytest.mark.parametrize("chunk", [512, 4])
def test_links_of_each_row(spark, monkeypatch, chunk):
    """Links within a component are counted too, copies of a text one by one, in one block or in many."""
    import random

    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    r = random.Random(4)
    rows, n = fixtures.texts(), 1000
    for _ in range(3):
        text = fixtures.words(r, 100).split()
        for _ in range(20):
            text = list(text)
            for _ in range(r.randint(0, 2)):
                text[r.randrange(len(text))] = f"new{n}"
            rows.append((n, " ".join(text)))
            n += 1
    df = fixtures.frame(spark, rows)
    got = jaccard_join.near_duplicate_links(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in got) == brute_links(rows, 3, 90)
    assert Counter(tuple(r)[:3] for r in got) == brute_components(rows, 3, 90)
    assert jaccard_join.near_duplicate_links(fixtures.empty(spark)).collect() == []


def test_few_pairs_are_few_files(spark, monkeypatch):
    found, staged = {}, jaccard_join.staged

    def counted(df, name, **options):
        out = staged(df, name, **options)
        found.setdefault(name, []).append(len(out.inputFiles()))
        return out

    rows = [(2 * n + k, f"{' '.join(f'w{n}x{i}' for i in range(60))} {'end' * k}") for n in range(60) for k in range(2)]
    monkeypatch.setattr(jaccard_join, "staged", counted)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = jaccard_join.near_duplicates(fixtures.frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i - i % 2) for i, _ in rows}
    assert max(found["jaccard-verified"]) <= 4


def test_one_of_each_group_stays(spark):
    rows = fixtures.texts()
    df = fixtures.frame(spark, rows)
    left = jaccard_join.without_near_duplicates(df)
    assert left.columns == df.columns
    kept = left.collect()
    members = jaccard_join._grouped(df, 5, 80, "doc_id", "text").where("n_shingles > 0").select("root").distinct().count()
    wordless = sum(not WORD.search(t or "") for _, t in rows)
    assert len(kept) == members + wordless
    assert jaccard_join.without_near_duplicates(fixtures.empty(spark)).collect() == []


def brute_removed(rows, length):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = Counter()
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[(i, len(b), int(gone.sum()), int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])) if len(b) else 0, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("length", "gram"), [(200, 50), (40, 12)])
def test_suffix_dedup(spark, length, gram):
    rows = fixtures.texts()
    got = suffix_dedup.removed_repeats(fixtures.frame(spark, rows), length, gram).collect()
    assert Counter(map(tuple, got)) == brute_removed(rows, length)
    texts = suffix_dedup.deduplicated(fixtures.frame(spark, rows), length, gram).collect()
    assert Counter((r.doc_id, hashlib.sha256(r.kept).hexdigest()) for r in texts) == Counter((x[0], x[4]) for x in brute_removed(rows, length).elements())


def test_suffix_dedup_in_segments(spark, monkeypatch):
    """Texts longer than a segment, with repeats across its edges."""
    import random

    r = random.Random(8)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    shared = fixtures.words(r, 150)
    rows = [(k, f"{fixtures.words(r, 100 + 37 * k)} {shared} {fixtures.words(r, 300)}") for k in range(6)]
    got = suffix_dedup.removed_repeats(fixtures.frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == brute_removed(rows, 200) and all(x.n_removed > 500 for x in got)


def test_suffix_dedup_gathers_ranges_of_repeated_rows_once(spark):
    import random

    text = fixtures.words(random.Random(9), 300)
    docs = suffix_dedup._keyed(fixtures.frame(spark, [(7, text)] * 500), "doc_id", "text")
    _, ranges = suffix_dedup._ranges(docs, 200, 50)
    assert ranges.distinct().count() < 100
    got = suffix_dedup.removed_repeats(fixtures.frame(spark, [(7, text)] * 500)).collect()
    assert len(got) == 500 and {(x.n_removed, x.n_spans) for x in got} == {(len(text), 1)}


def test_multikey_quicksort():
    rng = np.random.default_rng(2)
    for n, top in ((1, 3), (50, 2), (400, 3), (300, 50), (3000, 5)):
        words, groups = rng.integers(0, top, (n, 4)).astype(np.uint64), rng.integers(0, 7, n)
        order, starts = suffix_sort.multikey_quicksort(words, groups)
        want = np.lexsort((*(words[:, k] for k in (3, 2, 1, 0)), groups))
        keys = np.column_stack([groups.astype(np.uint64), words])
        assert sorted(order.tolist()) == list(range(n)) and (keys[order] == keys[want]).all()
        assert starts.tolist() == [0, *(np.flatnonzero((keys[order][1:] != keys[order][:-1]).any(axis=1)) + 1).tolist()]


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.removed_repeats(fixtures.empty(spark)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=70), min_size=1, max_size=30), st.integers(1, 3))
def test_deep_shallow_sorting(texts, groups):
    strings, group = [t.encode() for t in texts], np.arange(len(texts)) % groups
    order, prefix = suffix_sort.deep_shallow(strings, group)
    assert sorted(order.tolist()) == list(range(len(strings)))
    for a, b, p in zip(order, order[1:], prefix[1:], strict=False):
        assert (group[a], strings[a] + b"\xff") <= (group[b], strings[b] + b"\xff")
        assert p == (-1 if group[a] != group[b] else suffix_sort.common_prefix(strings[a], strings[b]))
