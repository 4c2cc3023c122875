"""Best-fit packing by a grouping genetic algorithm on islands, with a global best-fit-decreasing finish.

Pieces are tokenised once and written as rows of a few numbers. Runs of `BLOCK` consecutive pieces of a partition are
the instances: no key deals them, so nothing is skewed; the shorter runs at the ends of partitions are joined. Each block evolves on `ISLANDS` islands (a row per block and
island): a crossover injects full bins of one parent into the other, drops the bins that hold duplicates of the
injected pieces or aren't full, and packs the displaced pieces anew: first those that fill a bin exactly, then the
rest by best fit, longest first. Between epochs each island receives the elite of its neighbour. The bins of a block's best packing stay, full or not, unless fewer sequences come out without
them: groups of bins, the emptiest first (by the bits of their free tokens, full ones in `GROUPS` by hash), are given up
one after the other, and the pieces of those given up, of all blocks, are packed together by the exact
best-fit-decreasing plan of binpack, which needs only their histogram. The fewest groups that give the fewest sequences go.

Defined cases: a null text is an empty document, whose only id is the end id; repeated ids are packed row by row; a
very long text is cut into pieces of the capacity, all of which are packed; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm import binpack, tokens
from strataline.llm.common import lean, staged

BLOCK = 1024
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 6
POPULATION = 3
ELITES = 2
#: Pieces that may join one to fill a bin exactly.
FILLING = 4
GROUPS = 16
_ROW = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _fitness(loads: list[int], capacity: int) -> float:
    """Fewer bins first, then more that are full, then fuller ones."""
    full = sum(x == capacity for x in loads)
    return (0.9 * full + 0.1 * sum((x / capacity) ** 2 for x in loads)) / (len(loads) + 1) - len(loads)


def repaired(bins: list[list[int]], displaced: list[int], lengths: list[int], capacity: int, random: np.random.Generator) -> list[list[int]]:
    """bins with the displaced pieces put in: what fills a bin exactly goes first, the rest by best fit, longest first."""
    stock = binpack.Stock(displaced, lengths, capacity, random)
    for members in bins:
        if free := capacity - sum(lengths[i] for i in members):
            members.extend(stock.filling(free, FILLING) or ())
    left = []
    for length in sorted(stock.at, reverse=True):
        while stock.at[length]:
            i = stock.take(length)
            rest = stock.filling(capacity - length, FILLING) if length < capacity else []
            if rest is None:
                left.append(i)
            else:
                bins.append([i, *rest])
    tree, at = binpack.CapacityTree(capacity), {}
    for home, members in enumerate(bins):
        free = capacity - sum(lengths[i] for i in members)
        at.setdefault(free, []).append(home)
        tree.add(free, 1)
    for i in left:
        free = tree.tightest(lengths[i])
        if free < 0:
            bins.append([i])
            free, home = capacity, len(bins) - 1
        else:
            home = at[free].pop()
            tree.add(free, -1)
            bins[home].append(i)
        at.setdefault(free - lengths[i], []).append(home)
        tree.add(free - lengths[i], 1)
    return bins


def _full(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    return [x for x in bins if sum(lengths[i] for i in x) == capacity]


def crossover(a: list[list[int]], b: list[list[int]], lengths: list[int], capacity: int, random: np.random.Generator) -> list[list[int]]:
    """Child of a with some of b's full bins; a's bins that aren't full, or hold pieces of these, are packed anew."""
    filled = _full(b, lengths, capacity)
    if not filled:
        return [list(x) for x in a]
    injected = [filled[k] for k in random.permutation(len(filled))[: max(1, len(filled) // 2)]]
    held = {i for x in injected for i in x}
    kept = [list(x) for x in injected] + [list(x) for x in _full(a, lengths, capacity) if held.isdisjoint(x)]
    held = {i for x in kept for i in x}
    return repaired(kept, [i for x in a for i in x if i not in held], lengths, capacity, random)


def mutated(a: list[list[int]], lengths: list[int], capacity: int, random: np.random.Generator) -> list[list[int]]:
    """a with the bins that aren't full and some of the others emptied, and their pieces packed anew."""
    gone = {k for k, x in enumerate(a) if sum(lengths[i] for i in x) < capacity} | {int(k) for k in random.permutation(len(a))[: max(1, len(a) // 10)]}
    return repaired([list(x) for k, x in enumerate(a) if k not in gone], [i for k in gone for i in a[k]], lengths, capacity, random)


def evolve(lengths: list[int], capacity: int, start: list[list[list[int]]], generations: int, seed: int) -> list[list[list[int]]]:
    """The ELITES best packings after some generations from a starting population."""
    random = np.random.default_rng(seed)
    score = lambda p: _fitness([sum(lengths[i] for i in x) for x in p], capacity)
    population = list(start) or [binpack.pack_block(lengths, capacity), repaired([], list(range(len(lengths))), lengths, capacity, random)]
    while len(population) < POPULATION:
        population.append(mutated(population[0], lengths, capacity, random) if len(population[0]) > 1 else [list(x) for x in population[0]])
    scored = sorted(((score(p), k, p) for k, p in enumerate(population)), key=lambda s: (-s[0], s[1]))[:POPULATION]
    lower, most, tick = -(-sum(lengths) // capacity), sum(lengths) // capacity, len(scored)
    for _ in range(generations):
        if len(scored[0][2]) == lower and len(_full(scored[0][2], lengths, capacity)) == most:
            break
        i, j = random.permutation(len(scored))[:2] if len(scored) > 1 else (0, 0)
        child = crossover(scored[i][2], scored[j][2], lengths, capacity, random)
        if len(child) > 1 and random.random() < 0.5:
            child = mutated(child, lengths, capacity, random)
        tick += 1
        scored = sorted([*scored, (score(child), tick, child)], key=lambda s: (-s[0], s[1]))[:POPULATION]
    return [p for _, _, p in scored[:ELITES]]


def _packed(bins: list[list[int]], n: int) -> bytes:
    """Bin number of each piece, 16-bit."""
    out = np.zeros(n, np.uint16)
    for number, members in enumerate(bins):
        out[members] = number
    return out.tobytes()


def _unpacked(blob: bytes) -> list[list[int]]:
    numbers = np.frombuffer(blob, np.uint16)
    order = np.argsort(numbers, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1)] if len(order) else []


def _island(rows: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """rows (block, island, lengths, elites) to (block, island, elite, score) after an epoch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                lengths = np.frombuffer(r["lengths"], np.uint16).astype(int).tolist()
                found = evolve(lengths, capacity, [_unpacked(e) for e in r["elites"] or []], GENERATIONS, zlib.crc32(f"{r['block']} {r['island']} {epoch}".encode()))
                for p in found:
                    out.append({"block": r["block"], "island": r["island"], "elite": _packed(p, len(lengths)), "score": _fitness([sum(lengths[i] for i in x) for x in p], capacity)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("block", pa.int64()), ("island", pa.int32()), ("elite", pa.binary()), ("score", pa.float64())]))

    return rows.select("block", "island", "lengths", "elites").mapInArrow(lean(run), "block long, island int, elite binary, score double")


def tokenised_blocks(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """A written row for each block: its number and its pieces' doc_id, piece, start, length and crc as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("lengths", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("crcs", pa.list_(pa.int64()))])
        number, rows = TaskContext.get().partitionId() << 32, []

        def block() -> pa.RecordBatch:
            ids, pieces, starts, lengths, crcs = map(list, zip(*rows, strict=True))
            return pa.RecordBatch.from_pylist([{"block": number, "lengths": np.array(lengths, np.uint16).tobytes(), "doc_ids": ids, "pieces": pieces, "starts": starts, "crcs": crcs}], schema=schema)

        for batch in batches:
            for doc_id, piece, start, ids in tokens.pieces_of(batch, path, capacity):
                rows.append((doc_id, piece, start, len(ids), zlib.crc32(ids.tobytes())))
                if len(rows) == BLOCK:
                    yield block()
                    number, rows = number + 1, []
        if rows:
            yield block()

    return staged(docs.mapInArrow(lean(run), "block long, lengths binary, doc_ids array<long>, pieces array<int>, starts array<long>, crcs array<long>"), "packing-blocks")


def joined_ends(blocks: DataFrame) -> DataFrame:
    """blocks (a written table) with those of fewer than BLOCK pieces joined to blocks of at most so many: tables of many small partitions too have whole blocks."""
    pieces = F.size("crcs")
    homes, home, held = [], 0, BLOCK
    for number, count in blocks.where(pieces < BLOCK).select("block", pieces).orderBy("block").collect():
        if held + count > BLOCK:
            home, held = number, 0
        held += count
        homes.append((number, home))
    if len({h for _, h in homes}) == len(homes):
        return blocks
    ends = blocks.join(F.broadcast(blocks.sparkSession.createDataFrame(homes, "block long, home long")), "block")
    parts = ["block", "lengths", "doc_ids", "pieces", "starts", "crcs"]
    lists = ends.groupBy(F.col("home").alias("block")).agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("ends"))
    joined = lists.select(
        "block",
        F.aggregate("ends.lengths", F.lit(b""), lambda a, b: F.concat(a, b)).alias("lengths"),
        *(F.flatten(F.col("ends." + name)).alias(name) for name in parts[2:]),
    )
    return blocks.where(pieces == BLOCK).unionByName(staged(joined, "packing-ends"))


def block_pieces(blocks: DataFrame, capacity: int) -> DataFrame:
    """A row for each piece of blocks with a column best (bin numbers): its bin, its place there and the bin's free tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "free"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for r in batch.to_pylist():
                lengths = np.frombuffer(r["lengths"], np.uint16).astype(np.int64)
                ids, offsets, free = (np.zeros(len(lengths), np.int64) for _ in range(3))
                for number, members in enumerate(_unpacked(r["best"])):
                    ends = np.cumsum(lengths[members])
                    ids[members] = r["block"] * BLOCK + number
                    offsets[members] = ends - lengths[members]
                    free[members] = capacity - ends[-1]
                columns = [r["doc_ids"], r["pieces"], r["starts"], lengths, r["crcs"], ids, offsets, free]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return blocks.select("block", "lengths", "doc_ids", "pieces", "starts", "crcs", "best").mapInArrow(lean(run), f"{_ROW}, sequence_id long, offset long, free long")


def evolved(blocks: DataFrame, capacity: int) -> DataFrame:
    """(block, best): each block's best packing over its islands, after the epochs and migrations."""
    islands = blocks.select("block", "lengths").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    count = max(1, blocks.count() * ISLANDS)
    spread = min(count, 4 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    elites = None
    for epoch in range(EPOCHS):
        if elites is None:
            rows = islands.withColumn("elites", F.lit(None).cast("array<binary>")).repartition(spread)
        else:
            moved = elites.withColumn("island", F.explode(F.array("island", ((F.col("island") + 1) % ISLANDS))))
            rows = islands.join(moved.groupBy("block", "island").agg(F.sort_array(F.collect_list("elite")).alias("elites")), ["block", "island"])
        elites = staged(_island(rows, capacity, epoch), "packing-elites")
    return elites.groupBy("block").agg(F.max_by("elite", F.struct("score", "elite")).alias("best"))


def pack(docs: DataFrame, capacity: int = tokens.CAPACITY, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    blocks = joined_ends(tokenised_blocks(tokens.pairs(docs, key, text), path or tokens.tokenizer_path(), capacity))
    placed = staged(block_pieces(blocks.join(evolved(blocks, capacity), "block"), capacity), "packing-pieces")
    levels = capacity.bit_length()
    group = F.when(F.col("free") > 0, levels - F.length(F.bin("free"))).otherwise(levels + F.pmod(F.xxhash64("sequence_id"), F.lit(GROUPS))).cast("int")
    counts: list[dict[int, int]] = [{} for _ in range(levels + GROUPS)]
    kept = [0] * len(counts)
    for number, length, count, firsts in placed.groupBy(group.alias("g"), "length").agg(F.count(F.lit(1)), F.count_if(F.col("offset") == 0)).collect():
        counts[number][length] = count
        kept[number] += firsts
    released, runs, bins = _released(counts, kept, capacity)
    if not released:
        return placed.drop("free")
    gone = group < released
    loose = staged(binpack.numbered(placed.where(gone).drop("sequence_id", "offset", "free")), "packing-loose")
    return placed.where(~gone).drop("free").unionByName(binpack.place(loose, runs, first_id=-bins))


def _released(counts: list[dict[int, int]], kept: list[int], capacity: int) -> tuple[int, dict, int]:
    """How many groups of islands' bins are given up: the fewest that give the fewest sequences.

    counts has the lengths of each group's pieces, kept its bins. Returns that number, the plan's runs and its bins.
    """
    pool, best = {}, (sum(kept), 0, {}, 0)
    lower = -(-sum(k * v for c in counts for k, v in c.items()) // capacity)
    for released, extra in enumerate(counts, 1):
        if best[0] == lower:
            break
        for length, count in extra.items():
            pool[length] = pool.get(length, 0) + count
        if extra:
            bins, runs = binpack.plan(pool, capacity)
            best = min(best, (bins + sum(kept[released:]), released, runs, bins), key=lambda x: x[0])
    return best[1:]
