"""Token output and packing: exact round trips against the public tokenizer."""

import json
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strataline.llm import binpack, packing, token_output, tokens
from tests.llm import fixtures

CAPACITY = 2048
REFERENCE: dict = {}


@pytest.fixture(scope="module")
def pieces():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = Counter()
    for i, t in fixtures.texts():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        first = (len(ids) - 1) % CAPACITY + 1
        at = 0
        for k in range(-(-len(ids) // CAPACITY)):
            n = first if k == 0 else CAPACITY
            out[(i, k, at, n, zlib.crc32(ids[at : at + n].tobytes()))] += 1
            at += n
    return out


@pytest.mark.parametrize("pack", [packing.pack, lambda df: token_output.read_segments(token_output.write_matrices(df))])
def test_packed_sequences(spark, pieces, pack):
    rows = pack(fixtures.frame(spark, fixtures.texts())).collect()
    assert Counter(tuple(r)[:5] for r in rows) == pieces
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= CAPACITY
    total = sum(k[3] * n for k, n in pieces.items())
    assert len(sequences) <= -(-total // CAPACITY) + 1


def test_empty_tables(spark):
    assert packing.pack(fixtures.empty(spark)).collect() == []
    assert token_output.write_matrices(fixtures.empty(spark)).collect() == []


def test_matrix_rows(spark):
    rows = token_output.write_matrices(fixtures.frame(spark, fixtures.texts())).collect()
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == CAPACITY and r.cu_seqlens[0] == 0 and r.resets == r.cu_seqlens[:-1]
        assert r.id_bytes == 2 and (ids[r.cu_seqlens[-1] :] == 0xFFFF).all() and (ids[: r.cu_seqlens[-1]] != 0xFFFF).all()


def test_wide_ids(spark, tmp_path, pieces):
    """A vocabulary of more than 16 bits takes four bytes an id; the round trip is the same."""
    with open(tokens.tokenizer_path(), encoding="utf-8") as f:
        found = json.load(f)
    found["added_tokens"].append({"id": 70_000, "content": "<|wide|>"})
    path = tmp_path / "wide.json"
    path.write_text(json.dumps(found), encoding="utf-8")
    df = fixtures.frame(spark, [*fixtures.texts(), (500, "a <|wide|> b")])
    matrices = token_output.write_matrices(df, path=str(path))
    rows = token_output.read_segments(matrices).collect()
    assert {r.id_bytes for r in matrices.collect()} == {4}
    assert Counter(tuple(r)[:5] for r in rows if r.doc_id != 500) == pieces
    assert 70_000 in tokens.document_ids("a <|wide|> b", str(path)).tolist()


def test_ranks_stay_whatever_the_split(spark):
    """Ranks are columns of the written table: reading it in other splits places the same pieces."""
    df = fixtures.frame(spark, fixtures.texts() * 4).repartition(7)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    placed = packing.pack(df)
    try:
        first = placed.collect()
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        again = packing.pack(df).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert Counter(tuple(r)[:5] for r in first) == Counter(tuple(r)[:5] for r in again)
    for rows in (first, again):
        assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_same_ids_as_the_public_tokenizer():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("", " ", "a  b", "\n\n x", "don't WE'LL 's", "naïve 😀 x\x00y", "tab\t tab", "1234 5 67", "a\u00a0b", "end \n"):
        assert tokens.document_ids(text, tokens.tokenizer_path()).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_added_tokens_as_the_public_tokenizer():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()} == tokens.encoding_of(tokens.tokenizer_path())._special_tokens
    for text in ("abc <|endoftext|> d", "<|endoftext|>", "a  <|endoftext|>  b\n<|endoftext|><|endoftext|>'s", "<|endoftext|", "<|EndOfText|> <|pad|>", "x<|endoftext|>y" * 3000):
        assert tokens.document_ids(text, tokens.tokenizer_path()).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.lists(st.sampled_from(["<|endoftext|>", " ", "a", "'s", "\n", "1", "é", "<|", "😀"]), max_size=12).map("".join))
def test_ids_of_any_text(text):
    tokenizer = REFERENCE.get("t") or REFERENCE.setdefault("t", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert tokens.document_ids(text, tokens.tokenizer_path()).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_equals_best_fit_decreasing(lengths):
    bins = binpack.pack_block(lengths, 64)
    count, runs = binpack.plan(Counter(lengths), 64)
    assert count == len(bins)
    filled = {}
    for length, n in Counter(lengths).items():
        for rank in range(n):
            first, home, each, offset = runs[length][bisect_right([r[0] for r in runs[length]], rank) - 1]
            filled.setdefault(home + (rank - first) // each, []).append((offset + length * ((rank - first) % each), length))
    assert len(filled) == count
    for s in filled.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=2, max_size=120), st.integers(0, 99))
def test_crossover_keeps_every_piece_once(lengths, seed):
    random = np.random.default_rng(seed)
    a = binpack.pack_block(lengths, 100)
    b = packing.mutated(a, lengths, 100, random) if len(a) > 1 else a
    for child in (packing.crossover(a, b, lengths, 100, random), *packing.evolve(lengths, 100, [], 3, seed)):
        assert sorted(i for x in child for i in x) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in x) <= 100 for x in child)
        assert len(packing._unpacked(packing._packed(child, len(lengths)))) == len(child)


def test_the_genetic_packer_fills_nearly_all_bins():
    """Bins of the islands stay if they are full: few were, as no generation bettered the best-fit start."""
    random = np.random.default_rng(5)
    lengths = [int(n) for n in np.clip(random.lognormal(6.5, 0.8, 1024), 1, 2048)]
    start = binpack.pack_block(lengths, 2048)
    best = packing.evolve(lengths, 2048, [], packing.GENERATIONS, 1)[0]
    inside = lambda bins: sum(len(x) for x in bins if sum(lengths[i] for i in x) == 2048)
    assert sorted(i for x in best for i in x) == list(range(1024)) and max(sum(lengths[i] for i in x) for x in best) <= 2048
    assert len(best) <= len(start) and inside(best) >= 0.95 * 1024 > inside(start)


def test_exact_fillings():
    random = np.random.default_rng(0)
    for seed in range(200):
        lengths = np.random.default_rng(seed).integers(1, 30, 12).tolist()
        stock = binpack.Stock(list(range(12)), lengths, 100, random)
        got = stock.filling(int(random.integers(1, 60)), 4) or []
        assert len(set(got)) == len(got) <= 4
        held = [i for pieces in stock.at.values() for i in pieces]
        assert sorted(held + got) == list(range(12)) and stock.counts.sum() == len(held) and (stock.counts >= 0).all()
    stock = binpack.Stock([0, 1, 2], [5, 7, 8], 100, random)
    assert stock.filling(10, 4) is None and sorted(stock.filling(15, 2)) == [1, 2] and stock.filling(5, 1) == [0]


def test_blocks_keep_what_the_islands_packed(spark):
    """Pieces of bins that aren't full go to the exact finish: half of them did."""
    random = np.random.default_rng(5)
    lengths = np.clip(random.lognormal(6.5, 0.8, 1024), 1, 2048).astype(np.uint16)
    row = (0, bytearray(lengths.tobytes()), list(range(1024)), [0] * 1024, [0] * 1024, [0] * 1024)
    blocks = spark.createDataFrame([row], "block long, lengths binary, doc_ids array<long>, pieces array<int>, starts array<long>, crcs array<long>")
    placed = packing.block_pieces(blocks.join(packing.evolved(blocks, CAPACITY), "block"), CAPACITY).collect()
    assert sorted(r.doc_id for r in placed) == list(range(1024))
    assert sum(r.sequence_id is not None for r in placed) >= 0.95 * 1024


def in_the_islands_bins(spark, lengths, parts):
    """How many of the pieces of documents of these lengths stay where the islands put them, and the sequences; places are checked."""
    docs = spark.createDataFrame([(k, " a" * (n - 1)) for k, n in enumerate(lengths)], "doc_id long, text string").repartition(parts)
    rows, sequences = packing.pack(docs).collect(), {}
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [x[0] for x in s] == [sum(x[1] for x in s[:k]) for k in range(len(s))] and s[-1][0] + s[-1][1] <= CAPACITY
    return sum(r.sequence_id >= 0 for r in rows), len(sequences)


def test_bins_that_cannot_be_full_stay(spark):
    """Only full bins stayed: of lengths that never fill one, none did."""
    assert in_the_islands_bins(spark, [700 + 7 * k % 300 for k in range(200)], 1) == (200, 100)


def test_small_partitions_have_whole_blocks(spark):
    """Each partition was a block of its own, however small, and few of its bins were full."""
    lengths = [int(n) for n in np.clip(np.random.default_rng(7).lognormal(6.5, 0.8, 400), 1, 2048)]
    inside, sequences = in_the_islands_bins(spark, lengths, 60)
    assert inside >= 0.9 * 400 and sequences <= len(binpack.pack_block(lengths, CAPACITY))


@pytest.mark.parametrize("sizes", [[3, 5], [700, 324, 1], [1024, 1000, 30, 1024, 2], [1024], [512, 512, 512]])
def test_joined_ends_keep_every_piece(spark, sizes):
    rows, at = [], 0
    for k, n in enumerate(sizes):
        ids = list(range(at, at + n))
        rows.append(((k << 32) + 5, bytearray(np.array([i % 2048 + 1 for i in ids], np.uint16).tobytes()), ids, [i % 7 for i in ids], [2 * i for i in ids], [3 * i for i in ids]))
        at += n
    blocks = spark.createDataFrame(rows, "block long, lengths binary, doc_ids array<long>, pieces array<int>, starts array<long>, crcs array<long>")
    found = packing.joined_ends(blocks).collect()
    assert sorted(x for r in found for x in zip(np.frombuffer(r.lengths, np.uint16).tolist(), r.doc_ids, r.pieces, r.starts, r.crcs, strict=True)) == sorted((i % 2048 + 1, i, i % 7, 2 * i, 3 * i) for i in range(at))
    counts = sorted(len(r.doc_ids) for r in found)
    assert counts[-1] <= packing.BLOCK and all(a + b > packing.BLOCK for a, b in zip(counts, counts[1:])) and len({r.block for r in found}) == len(found)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 64), max_size=30), max_size=6))
def test_the_fewest_groups_that_give_the_fewest_sequences_go(groups):
    counts, kept = [Counter(g) for g in groups], [len(g) for g in groups]
    released, runs, bins = packing._released(counts, kept, 64)
    totals = [sum(kept), *(binpack.plan(sum(counts[:k], Counter()), 64)[0] + sum(kept[k:]) for k in range(1, len(groups) + 1))]
    assert released == totals.index(min(totals)) and bins + sum(kept[released:]) == min(totals)
    assert {length for length in runs if runs[length]} == {n for g in groups[:released] for n in g}


def test_workers_hold_one_vocabulary_and_few_texts():
    import sys

    import pyarrow as pa

    from strataline.llm import common, words

    words.vocabulary(with_shapes=True).numbers([b"a", b"b"])
    words.vocabulary()
    assert [k for k in sys.__dict__["_strataline_cache"] if k.startswith("vocabulary")] == ["vocabulary False"]
    column = pa.array([None if n % 7 == 0 else "x" * n for n in range(1000)]).slice(3)
    assert list(common.values_of(column)) == column.to_pylist() and list(common.values_of(column.slice(0, 0))) == []


def test_idle_workers_hold_no_vocabulary(spark):
    import pyarrow as pa

    from strataline.llm import jaccard_join, quality_classifier

    def held(batches):
        import sys

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(k.startswith("vocabulary ") for k in sys.__dict__.get("_strataline_cache", {}))], pa.int64())], names=["n"])

    df = fixtures.frame(spark, fixtures.texts())
    labels = spark.createDataFrame([(i, i % 2) for i, _ in fixtures.texts() if i], "doc_id long, quality int")
    for work in (jaccard_join.near_duplicates(df), quality_classifier.quality_scores(df, labels)):
        work.collect()
        assert {r.n for r in spark.range(0, 16, 1, 16).mapInArrow(held, "n long").collect()} == {0}
