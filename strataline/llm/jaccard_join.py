"""N-gram Jaccard self-join with set-relation skipping, and the classes that its links form.

Sets are distinct word shingles, as 64-bit hashes. Documents of equal sets are one class (a key of their own), so
copies never meet in pairs. Tokens are ordered from rare to frequent by a sketch of counts over all documents (a
fixed-size table, broadcast); any order is exact, this one keeps frequent passages out of the prefixes. Two sets at or
above the threshold share `SHARED` tokens of their prefixes (or their whole overlap, if that is smaller), so the index
lists hold prefixes only, and pairs that share fewer tokens of them are never looked at.

Index-level skipping: lists are sorted by size and then by the token's position, in blocks that know their sizes, their
furthest positions and their components; a block beyond a set's size or position bound is skipped whole.

Answer-level skipping: first every class is verified against one leader only, of the leaders of its lists' size blocks
the one that it shares most tokens with (a star: one pair a class); classes that share tokens with other components
are then verified against one hub, the leader of most classes among their lists. An answer keeps the few elements in
which leader and class differ. The overlap of two classes with answers from the same leader follows from these
differences alone (`_derived`), so neither their sets nor their lists are looked at again. Only pairs of different
components without a common leader are left to be verified, and no link between different components is lost.

Links of a row (`near_duplicate_links`): links lie within components, so all pairs of classes of a component are
counted, in blocks of `CHUNK` classes by `CHUNK` that are dealt out one by one; copies count as often as they occur.

Defined cases: null or wordless texts have an empty set, are linked with nothing and are their own component; with
fewer words than a shingle the whole sequence is the one element; repeated ids are separate rows; an empty table gives
an empty result; extra columns are ignored; very long texts are one set each, whole.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.llm.common import SEPARATORS, bit_set, lean, staged, values_of
from strataline.llm.components import components
from strataline.llm.words import mix, vocabulary

#: Buckets of the frequency sketch: 4 MB of counts whatever the corpus.
SKETCH_BITS = 20
#: Tokens of two prefixes that sets at the threshold must share.
SHARED = 3
#: Bits of the set that tells which documents to shuffle: 4 MB whatever the corpus.
BITS = 25
#: Members that one copy of a leader's set is compared with in one task.
STAR = 256
#: Classes, and tokens of them, that one side of a block of pairs holds on average at most.
CHUNK, CHUNK_TOKENS = 512, 1 << 20
#: Letters of texts that are hashed together.
TOGETHER = 1 << 21
#: Rows of at most 40 bytes that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_HALF = 1 << 16
#: Entries of a list that are skipped together.
SKIP = 64


def shingle_sets(texts: Iterable[str | None], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; texts are hashed together, about TOGETHER letters at a time."""
    held: list[list[bytes]] = []
    letters = 0
    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass").lower().split())
        letters += len(text or "")
        if letters > TOGETHER:
            yield from _sets_of(held, words)
            held, letters = [], 0
    yield from _sets_of(held, words)


def _sets_of(found: list[list[bytes]], words: int) -> Iterator[np.ndarray]:
    vocab = vocabulary()
    numbers = vocab.numbers(list(itertools.chain.from_iterable(found)))
    h = vocab.hashes[numbers]
    count = max(0, len(h) - words + 1)
    # Windows that reach into the next text are left out below.
    windows = mix(*(h[i : count + i] for i in range(words)))
    at = 0
    for own in found:
        n = len(own)
        if n < words:
            yield mix(*(h[at + i : at + i + 1] for i in range(n))) if n else np.zeros(0, np.uint64)
        else:
            s = np.sort(windows[at : at + n - words + 1])
            fresh = np.empty(len(s), bool)
            fresh[0] = True
            np.not_equal(s[1:], s[:-1], out=fresh[1:])
            yield s[fresh]
        at += n


def classes_of(sets: list[np.ndarray]) -> np.ndarray:
    """64-bit keys of sets: equal sets, equal keys."""
    sizes = np.array([len(s) for s in sets], np.int64)
    total, odd = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    if some := [s for s in sets if len(s)]:
        held, own = np.concatenate(some), sizes[sizes > 0]
        starts = np.cumsum(own) - own
        total[sizes > 0], odd[sizes > 0] = np.add.reduceat(held, starts), np.bitwise_xor.reduceat(held, starts)
    return _signed(mix(total, odd, sizes.astype(np.uint64)))


def prefix_size(n: int, percent: int) -> int:
    """Tokens of a set of n in which SHARED common ones must lie."""
    return min(n, n + (-percent * n) // 100 + SHARED)


def needed(na, nb, percent: int):
    """The smallest overlap at which 100 * overlap >= percent * union."""
    return -(-percent * (na + nb) // (100 + percent))


def _docs(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), row_key(F.col(key), F.col(text)).alias("key"))


def row_key(doc_id: Column, text: Column) -> Column:
    """64-bit key of a row's id and text; equal rows share it."""
    return F.xxhash64(doc_id.cast("long"), text)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _profiles(docs: DataFrame, words: int) -> DataFrame:
    """Written rows (doc_id, n, cls, key), and per task a row n = -1 with the sketch of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = ["doc_id", "n", "cls", "key", "sketch"], np.zeros(1 << SKETCH_BITS, np.uint32)
        shift = np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            n, cls, pending, held = [], [], [], 0
            for at, own in enumerate(shingle_sets(values_of(batch.column(1)), words), 1):
                n.append(len(own))
                pending.append(own)
                held += len(own)
                if held > 1 << 20 or at == batch.num_rows:
                    cls.append(classes_of(pending))
                    counts += np.bincount((np.concatenate(pending) >> shift).astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
                    pending, held = [], 0
            if n:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(np.concatenate(cls)), batch.column(2), pa.nulls(len(n), pa.binary())], names=names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([zlib.compress(counts.tobytes(), 1)])], names=names)

    return staged(docs.mapInArrow(lean(run), "doc_id long, n long, cls long, key long, sketch binary"), "jaccard-profiles")


def _sketch(profiles: DataFrame) -> np.ndarray:
    """The tasks' sketches summed in two levels of streaming tasks; one fixed-size table reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column(0):
                part = np.frombuffer(zlib.decompress(blob.as_py()), np.uint32)
                total = part.copy() if total is None else np.minimum(total.astype(np.uint64) + part, 2**32 - 1).astype(np.uint32)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)])], names=["sketch"])

    blobs = profiles.where("n = -1").select("sketch")
    found = blobs.repartition(16).mapInArrow(add, "sketch binary").repartition(1).mapInArrow(add, "sketch binary").collect()
    return np.frombuffer(zlib.decompress(bytes(found[0][0])), np.uint32) if found else np.zeros(1 << SKETCH_BITS, np.uint32)


def _prefixes(docs: DataFrame, sketch: np.ndarray, words: int, percent: int) -> DataFrame:
    """(token, n, pos, cls) of each class's prefix; copies in one task are emitted once."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, shift = sent.value, set(), np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            tokens, sizes, places, classes, pending, held = [], [], [], [], [], 0
            for at, own in enumerate(shingle_sets(values_of(batch.column(1)), words), 1):
                pending.append(own)
                held += len(own)
                if held <= 1 << 19 and at < batch.num_rows:
                    continue
                for s, cls in zip(pending, classes_of(pending).tolist(), strict=True):
                    if not len(s) or cls in seen:
                        continue
                    seen.add(cls)
                    p = prefix_size(len(s), percent)
                    order = np.argsort(counts[(s >> shift).astype(np.int64)], kind="stable")[:p]
                    tokens.append(s[order])
                    sizes.append(np.full(p, len(s), np.int32))
                    places.append(np.arange(p, dtype=np.int32))
                    classes.append(np.full(p, cls, np.int64))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(tokens))), *(pa.array(np.concatenate(x)) for x in (sizes, places, classes))], names=["token", "n", "pos", "cls"])
                tokens, sizes, places, classes, pending, held = [], [], [], [], [], 0

    return docs.mapInArrow(lean(run), "token long, n int, pos int, cls long")


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches as tables that cut no run of equal tokens; a batch is looked at once, however long a run."""
    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        token = batch.column(batch.schema.get_field_index("token")).to_numpy()
        cut = int(np.searchsorted(token, token[-1]))
        if cut == 0 and token[0] == last or rows + cut < _HALF:
            held.append(batch)
            rows += batch.num_rows
        else:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held)
            held, rows = [batch.slice(cut)], batch.num_rows - cut
        last = token[-1]
    if held:
        yield pa.Table.from_batches(held)


def _postings(prefixes: DataFrame, percent: int) -> DataFrame:
    """Written lists of tokens that two classes share, each entry with its block's leader and whether the star tests it."""
    step = -np.log(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches):
            token, n, pos, cls = (table.column(c).to_numpy() for c in ("token", "n", "pos", "cls"))
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
            token, n, pos, cls = token[fresh], n[fresh], pos[fresh], cls[fresh]
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            shared = np.repeat(np.diff(np.r_[starts, len(token)]) > 1, np.diff(np.r_[starts, len(token)]))
            token, n, pos, cls = token[shared], n[shared], pos[shared], cls[shared]
            if not len(token):
                continue
            size = np.floor(np.log(n) / step).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (size[1:] != size[:-1])])
            lengths = np.diff(np.r_[starts, len(token)])
            # The leader has the fewest rarer tokens: the most central of a family, and mostly the same for all its tokens.
            first = np.lexsort((cls, pos, np.repeat(np.arange(len(starts)), lengths)))[starts]
            at = np.repeat(first, lengths)
            need = needed(n.astype(np.int64), n[at].astype(np.int64), percent)
            bound = np.minimum(pos, pos[at]) + 1 + np.minimum(n - pos - 1, n[at] - pos[at] - 1)
            tested = (cls != cls[at]) & (bound >= need) & (100 * np.minimum(n, n[at]).astype(np.int64) >= percent * np.maximum(n, n[at]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, n, pos, cls, cls[at], n[at], tested)], names=["token", "n", "pos", "cls", "leader", "leader_n", "tested"])

    parts = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = prefixes.repartition(parts, "token").sortWithinPartitions("token", "n", "pos", "cls")
    return staged(dealt.mapInArrow(lean(run), "token long, n int, pos int, cls long, leader long, leader_n int, tested boolean"), "jaccard-postings")


def _enough(na: str, nb: str, percent: int) -> Column:
    """Shared prefix tokens that a pair needs to be looked at."""
    need = F.ceil((F.lit(percent) * (F.col(na) + F.col(nb))) / F.lit(100 + percent))
    return F.least(F.lit(SHARED), need)


def _stars(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each class b the leader a that it shares most prefix tokens with."""
    votes = postings.where("tested").groupBy("leader", "cls", "n", "leader_n").count().where(F.col("count") >= _enough("n", "leader_n", percent))
    return votes.groupBy(F.col("cls").alias("b")).agg(F.max_by("leader", F.struct("count", "leader")).alias("a")).select("a", "b")


def _involved_texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Written (key, text) of the documents whose key is among keys, and of few others that a bit set can't tell apart."""
    sent = docs.sparkSession.sparkContext.broadcast(bit_set(keys, BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The bits stay packed: apart they take 16 times the memory.
        bits = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            at = (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)
            hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            if hit.any():
                yield batch.filter(pa.array(hit))

    found = docs.select("key", "text").mapInArrow(lean(run), "key long, text string")
    return staged(found, "jaccard-texts")


def _verified(pairs: DataFrame, known: DataFrame, texts: DataFrame, words: int, percent: int, answers: bool = False) -> DataFrame:
    """Written rows (a, b, na, nb, both, linked) of distinct pairs; a leader's set is copied for each STAR members.

    known has the key of a document for each class. With answers, a column delta holds the elements that only one of
    the two sets has, first those of a; it is null for pairs that share less than half of the larger set.
    """
    schema = "a long, b long, na int, nb int, both int, linked boolean" + (", delta array<long>" if answers else "")
    pairs = staged(pairs.select("a", "b"), "jaccard-pairs")
    if pairs.isEmpty():
        return pairs.sparkSession.createDataFrame([], schema)
    counted = pairs.groupBy("a").count().withColumn("salts", F.ceil(F.col("count") / STAR).cast("int")).drop("count")
    members = pairs.join(counted, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("cls"), F.lit(1).alias("side"))
    leaders = counted.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("cls"), F.lit(0).alias("side"))
    asked = staged(members.unionByName(leaders).join(known, "cls"), "jaccard-asked")
    few = asked.count() <= BROADCAST_ROWS
    asked = texts.join(F.broadcast(asked) if few else asked, "key").select("a", "salt", "side", "cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"a": pa.int64(), "b": pa.int64(), "na": pa.int32(), "nb": pa.int32(), "both": pa.int32(), "linked": pa.bool_()} | ({"delta": pa.list_(pa.int64())} if answers else {})

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

        current, leader, out, held = None, None, [], 0
        for batch in batches:
            for a, salt, side, cls, own in zip(*(c.to_pylist() for c in batch.columns[:4]), shingle_sets(values_of(batch.column(4)), words), strict=True):
                if classes_of([own])[0] != cls:  # another text of the same key
                    continue
                if side == 0:
                    current, leader = (a, salt), own
                    continue
                if current != (a, salt):
                    raise ValueError("a member came before its leader")
                where = np.searchsorted(leader, own)
                where[where == len(leader)] = 0
                hit = leader[where] == own
                both = int(np.count_nonzero(hit))
                row = (a, cls, len(leader), len(own), both, 100 * both >= percent * (len(leader) + len(own) - both))
                if answers:
                    delta = None
                    if 2 * both >= max(len(leader), len(own)):
                        left = np.ones(len(leader), bool)
                        left[where[hit]] = False
                        delta = _signed(np.concatenate([leader[left], own[~hit]]))
                        held += len(delta)
                    row = (*row, delta)
                out.append(row)
                if len(out) >= 4096 or held > 1 << 18:
                    yield table(out)
                    out, held = [], 0
        if out:
            yield table(out)

    # No number: few pairs are few tasks and few files.
    dealt = asked.repartition("a", "salt").sortWithinPartitions("a", "salt", "side")
    return staged(dealt.mapInArrow(lean(run), schema), "jaccard-verified")


def _mixed(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """Written lists (token, n, pos, before, cls, root) of tokens that classes of different components share.

    before: how many of the class's earlier tokens are in any list; of these alone others can be common.
    """
    placed = postings.withColumn("before", F.row_number().over(Window.partitionBy("cls").orderBy("pos")) - 1)
    rooted = placed.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    several = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    return staged(rooted.join(several, "token").select("token", "n", "pos", "before", "cls", "root"), "jaccard-mixed")


def _hubs(mixed: DataFrame, stars: DataFrame) -> DataFrame:
    """(a, b): for each class b of the mixed lists the leader a of most members that it shares SHARED tokens with."""
    sizes = stars.where("delta IS NOT NULL").groupBy(F.col("a").alias("cls")).agg(F.count("*").alias("members")).where("members > 1")
    best = mixed.join(sizes, "cls").groupBy("token").agg(F.max(F.struct("members", "cls")).alias("hub"))
    met = mixed.join(best, "token").where("cls <> hub.cls").groupBy("cls", "hub").count().where(F.col("count") >= SHARED)
    chosen = met.groupBy(F.col("cls").alias("b")).agg(F.max("hub").getField("cls").alias("a"))
    return chosen.join(stars.select("a", "b"), ["a", "b"], "left_anti").select("a", "b")


class Blocks:
    """A list's entries, sorted by size and place, in blocks of SKIP: which blocks may hold a partner of an entry."""

    def __init__(self, n: np.ndarray, place: np.ndarray, rest: np.ndarray, root: np.ndarray) -> None:
        starts = np.arange(0, len(n), SKIP)
        self.count, self.starts = len(n), starts
        self.low_n, self.high_n = np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts)
        self.place, self.rest = np.maximum.reduceat(place, starts), np.maximum.reduceat(rest, starts)
        self.low_root, self.high_root = np.minimum.reduceat(root, starts), np.maximum.reduceat(root, starts)

    def after(self, i: int, n: int, place: int, rest: int, root: int, most: int, need) -> np.ndarray:
        """Places of entries after i in blocks with some size up to most, another root, and room for the overlap needed."""
        k = np.arange(i // SKIP, len(self.starts))
        k = k[(self.low_n[k] <= most) & ((self.low_root[k] != root) | (self.high_root[k] != root))]
        k = k[np.minimum(self.place[k], place) + 1 + np.minimum(self.rest[k], rest) >= need(n, np.maximum(self.low_n[k], n))]
        if not len(k):
            return k
        j = (self.starts[k][:, None] + np.arange(SKIP)).ravel()
        return j[(j > i) & (j < self.count)]


def _derived(stars: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Written links (a, b) between classes with an answer from the same leader L, from these answers alone.

    With D the elements of L that a class lacks, A those that it has beyond L and delta the two together, the overlap of
    x and y is |L| - |Dx| - |Dy| + |delta x & delta y|: the leader's answers and the few elements in which its sets
    differ give theirs. A pair with both linked to L is joined through L; of any other at least one has
    W = 100 |D| + percent |A| over K = (100 - percent) |L|, so that the deltas must share more than W / (100 + percent)
    elements, W of the other. An index over the rarest elements of the deltas finds all such pairs.
    """
    unit = 100 + percent
    answers = stars.where("delta IS NOT NULL").select(F.col("a").alias("via"), F.col("b").alias("cls"), "na", "nb", "delta", (F.col("na") - F.col("both")).alias("minus"), (F.col("nb") - F.col("both")).alias("plus")).dropDuplicates(["via", "cls"])
    answers = answers.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    some = answers.groupBy("via").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("via")
    weight, free = 100 * F.col("minus") + percent * F.col("plus"), (100 - percent) * F.col("na")
    least = F.when(weight <= free, F.floor(weight / unit) + 1).otherwise(F.greatest(F.lit(1), F.ceil((weight - free) / unit)))
    answers = staged(answers.join(some, "via").withColumns({"far": weight > free, "least": least.cast("int")}), "jaccard-answers")
    if answers.isEmpty():
        return answers.select(F.col("via").alias("a"), F.col("cls").alias("b"))
    # Elements that no other delta of the leader has can't be shared; without them more deltas become too small.
    each = answers.select("via", "cls", "root", "na", "nb", "minus", "far", "least", F.explode("delta").alias("x"))
    own, same = Window.partitionBy("via", "cls"), Window.partitionBy("via", "x")
    for _ in range(2):
        each = each.withColumn("held", F.count("*").over(same)).where("held > 1").withColumn("size", F.count("*").over(own)).where("size >= least")
    ranked = each.withColumn("place", F.row_number().over(own.orderBy("held", "x")) - 1)
    listed = ranked.where("place <= size - least").withColumn("token", F.xxhash64("via", "x"))
    several = listed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("far").alias("any")).where("lo <> hi AND any").select("token")
    listed = listed.join(several, "token").select("token", F.col("nb").alias("n"), "place", F.col("size"), "cls", "root", "via", "na", "minus", F.col("far").cast("int").alias("far"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches):
            token, n, place, size, cls, root, via, na, minus, far = (table.column(i).to_numpy().astype(np.int64) for i in range(10))
            edges = np.r_[np.flatnonzero(np.r_[True, token[1:] != token[:-1]]), len(token)]
            found: list[tuple[np.ndarray, ...]] = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                at = slice(lo, hi)
                index = Blocks(n[at], place[at], size[at] - place[at] - 1, root[at])
                for i in range(lo, hi - 1):
                    most = 100 * n[i] // percent
                    j = lo + index.after(i - lo, n[i], place[i], size[i] - place[i] - 1, root[i], most, lambda own, other: np.ones(len(other), np.int64))
                    j = j[(root[j] != root[i]) & (via[j] == via[i]) & (n[j] <= most) & (far[j] + far[i] > 0)]
                    need = needed(n[i], n[j], percent) - na[i] + minus[i] + minus[j]
                    j = j[np.minimum(place[i], place[j]) + 1 + np.minimum(size[i] - place[i] - 1, size[j] - place[j] - 1) >= need]
                    found.append((np.full(len(j), via[i]), np.minimum(cls[j], cls[i]), np.maximum(cls[j], cls[i])))
            if any(len(x[0]) for x in found):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["via", "a", "b"])

    parts = int(stars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = listed.repartition(parts, "token").sortWithinPartitions("token", "n", "place", "cls")
    emitted = dealt.mapInArrow(lean(run), "via long, a long, b long")
    pairs = staged(emitted.distinct(), "jaccard-derivable")
    one, other = (answers.select("via", F.col("cls").alias(c), F.col("na").alias(f"l{c}"), F.col("nb").alias(f"n{c}"), F.col("minus").alias(f"m{c}"), F.col("delta").alias(f"d{c}")) for c in "ab")
    few = pairs.count() <= BROADCAST_ROWS
    both = other.join(one.join(F.broadcast(pairs) if few else pairs, ["via", "a"]), ["via", "b"])
    overlap = F.col("la") - F.col("ma") - F.col("mb") + F.size(F.array_intersect("da", "db"))
    return staged(both.where(100 * overlap >= percent * (F.col("na") + F.col("nb") - overlap)).select("a", "b").distinct(), "jaccard-derived")


def _left_pairs(mixed: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of different components that have no leader's answer in common."""
    vias = stars.where("delta IS NOT NULL").groupBy(F.col("b").alias("cls")).agg(F.min("a").alias("via"), F.max("a").alias("also"))
    known = mixed.join(vias, "cls", "left").select("token", "n", "pos", "before", "cls", "root", F.coalesce("via", "cls").alias("via"), F.coalesce("also", "cls").alias("also"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches):
            token, n, pos, before, cls, root, via, also = (table.column(i).to_numpy().astype(np.int64) for i in range(8))
            edges = np.r_[np.flatnonzero(np.r_[True, token[1:] != token[:-1]]), len(token)]
            left, right, sizes = [], [], []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                index = Blocks(n[lo:hi], before[lo:hi], n[lo:hi] - pos[lo:hi] - 1, root[lo:hi])
                for i in range(lo, hi - 1):
                    # Later entries are at least as large; blocks beyond the size or position bound are skipped whole.
                    most = 100 * n[i] // percent
                    j = lo + index.after(i - lo, n[i], before[i], n[i] - pos[i] - 1, root[i], most, lambda own, other: needed(own, other, percent))
                    j = j[(root[j] != root[i]) & (n[j] <= most)]
                    j = j[np.minimum(before[i], before[j]) + 1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1) >= needed(n[i], n[j], percent)]
                    met = np.zeros(len(j), bool)
                    for x in (via, also, cls):
                        for y in (via, also, cls):
                            met |= x[j] == y[i]
                    j = j[~met]
                    if len(j):
                        left.append(np.full(len(j), cls[i]))
                        right.append(cls[j])
                        sizes.append(n[i] + n[j])
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.concatenate(sizes))], names=["a", "b", "size"])

    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = known.repartition(parts, "token").sortWithinPartitions("token", "n", "pos", "cls")
    found = dealt.mapInArrow(lean(run), "a long, b long, size long").groupBy("a", "b", "size").agg(F.count("*").alias("shared"))
    return found.withColumn("none", F.lit(0)).where(F.col("shared") >= _enough("size", "none", percent)).select("a", "b")


def near_duplicates(df: DataFrame, words: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row."""
    return _grouped(df, words, percent, key, text).select("doc_id", "n_shingles", "component_id")


def near_duplicate_links(df: DataFrame, words: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (other rows at the threshold or above, copies among them) of every row."""
    rows, classes, known, texts, roots = _resolved(df, words, percent, key, text)
    others = _linked_rows(classes, known, texts, roots, words, percent)
    final = _labels(classes, roots).join(others, "cls", "left").withColumn("n_links", F.col("n_rows") - 1 + F.coalesce("others", F.lit(0)))
    return _with_labels(rows, final).select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def without_near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df less all but one of each component: its smallest id stays. Rows without words all stay.

    What goes is told by row keys, broadcast while they are few enough and else joined by a shuffle.
    """
    grouped = staged(_grouped(df, words, percent, key, text).where("n_shingles > 0"), "jaccard-grouped")
    kept = grouped.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("kept")).select("root", F.col("kept.key").alias("kept"))
    gone = staged(grouped.join(kept, "root").where("key <> kept").select(F.col("key").alias("_gone")).distinct(), "jaccard-gone")
    few = gone.count()
    left = df.join(F.broadcast(gone) if few <= BROADCAST_ROWS else gone, row_key(F.col(key), F.col(text)) == F.col("_gone"), "left_anti")
    if grouped.groupBy("key").count().where("count > 1").isEmpty():
        return left
    again = left.withColumn("_n", F.row_number().over(Window.partitionBy(row_key(F.col(key), F.col(text))).orderBy(F.lit(1))))
    return again.where((F.col("_n") == 1) | (F.length(F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(SEPARATORS))) == 0)).drop("_n")


def _grouped(df: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """doc_id, key, n_shingles, root (class that stands for the component) and component_id of every row."""
    rows, classes, _, _, roots = _resolved(df, words, percent, key, text)
    return _with_labels(rows, _labels(classes, roots)).select("doc_id", "key", "root", "n_shingles", "component_id")


def _labels(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(cls, root, component_id, n_rows) of every class."""
    labelled = classes.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    return labelled.join(lowest, "root").select("cls", "root", "component_id", "n_rows")


def _with_labels(rows: DataFrame, final: DataFrame) -> DataFrame:
    """rows with their class's columns; rows without words are their own component."""
    found = rows.join(final, "cls", "left").withColumnRenamed("n", "n_shingles")
    return found.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b."""
    both = np.zeros((len(a), len(b)), np.int64)
    common = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    if not len(common):
        return both
    sides = []
    for sets in (a, b):
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(common, tokens)
        at[at == len(common)] = 0
        hit = common[at] == tokens
        at, owner = at[hit], owner[hit]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], owner[order], len(sets)))
    width = 1 << 12
    for low in range(0, len(common), width):
        parts = []
        for at, owner, count in sides:
            x, y = np.searchsorted(at, (low, low + width))
            part = np.zeros((count, min(width, len(common) - low)), np.float32)
            part[owner[x:y], at[x:y] - low] = 1
            parts.append(part)
        both += (parts[0] @ parts[1].T).astype(np.int64)
    return both


def _linked_rows(classes: DataFrame, known: DataFrame, texts: DataFrame, roots: DataFrame, words: int, percent: int) -> DataFrame:
    """(cls, others): rows of other classes that a class is linked with, of all pairs within its component."""
    members = roots.select(F.col("node").alias("cls"), "root").join(classes.select("cls", "n", "n_rows"), "cls").join(known, "cls")
    members = staged(members, "jaccard-members")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_TOKENS)).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")
    dealt = members.join(sizes, "root").withColumn("own", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")
    asked = staged(dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side, "cls", "n_rows", "key"), "jaccard-blocks")
    few = asked.count() <= BROADCAST_ROWS // 2
    asked = texts.join(F.broadcast(asked) if few else asked, "key").select("root", "i", "j", "side", "cls", "n_rows", "text")

    def counted(sides: tuple[dict, dict], within: bool) -> list[tuple[int, int]]:
        # Of a block on the diagonal there is one side, and a class is no other of itself.
        left, right = sides[0], sides[0] if within else sides[1]
        if not left or not right:
            return []
        (a, ma), (b, mb) = (zip(*x.values(), strict=True) for x in (left, right))
        na, nb, ma, mb = (np.array(x, np.int64) for x in ([len(s) for s in a], [len(s) for s in b], ma, mb))
        both = _overlaps(a, b)
        linked = (100 * both >= percent * (na[:, None] + nb[None, :] - both)).astype(np.int64)
        out = list(zip(left, (linked @ mb - (ma if within else 0)).tolist(), strict=True))
        return out if within else out + list(zip(right, (linked.T @ ma).tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], names=["cls", "others"])

        current, sides = None, ({}, {})
        for batch in batches:
            out = []
            for root, i, j, side, cls, n_rows, own in zip(*(c.to_pylist() for c in batch.columns[:6]), shingle_sets(values_of(batch.column(6)), words), strict=True):
                if current != (root, i, j):
                    if current:
                        out += counted(sides, current[1] == current[2])
                    current, sides = (root, i, j), ({}, {})
                if classes_of([own])[0] == cls:  # else another text of the same key
                    sides[side][cls] = (own, n_rows)
            if out:
                yield table(out)
        if current and (out := counted(sides, current[1] == current[2])):
            yield table(out)

    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = asked.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j", "side")
    return blocks.mapInArrow(lean(run), "cls long, others long").groupBy("cls").agg(F.sum("others").alias("others"))


def _resolved(df: DataFrame, words: int, percent: int, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows, classes, classes' document keys, involved texts and the roots of linked classes."""
    docs = _docs(df, key, text)
    profiles = _profiles(docs, words)
    postings = _postings(_prefixes(docs, _sketch(profiles), words, percent), percent)
    rows = profiles.where("n >= 0").select("doc_id", "n", "cls", "key")
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"), F.min("n").alias("n"), F.count("*").alias("n_rows"))
    known = staged(postings.select("cls").distinct().join(classes, "cls").select("cls", "key"), "jaccard-known")
    texts = _involved_texts(docs, known.select("key"))
    stars = _verified(_stars(postings, percent), known, texts, words, percent, answers=True)
    links = stars.where("linked").select("a", "b")
    roots = components(links)
    mixed = _mixed(postings, roots)
    if mixed.isEmpty():
        return rows, classes, known, texts, roots
    stars = stars.unionByName(_verified(_hubs(mixed, stars), known, texts, words, percent, answers=True))
    more = _derived(stars, roots, percent).unionByName(_verified(_left_pairs(mixed, stars, percent), known, texts, words, percent).where("linked").select("a", "b"))
    return rows, classes, known, texts, components(stars.where("linked").select("a", "b").unionByName(more))
