"""Benchmark decontamination by SimHashes of item-sized windows and multi-index Hamming blocks, in DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are five words (a shorter item's is all its words, and
documents are cut into shingles of such an item's length too). A window's and an item's features are their shingles, a
repeated one with the number of its occurrence: the intersection of two such sets is that of the multisets.

1. Windows slide over whole documents, a start at every word, one for each length of an item. Of a similar window so
   many shingles must be shingles of items of its length (`needed`) that places where fewer are can't start one; this
   test alone leaves windows out, and none that is similar to an item (it knows no item, only which shingles occur).
2. Each window left gets a 64-bit SimHash of its features. Fingerprints are cut into `RADIUS` + 1 blocks: two that
   differ in at most RADIUS bits are equal in one block, so a join on (length, block, value) meets all of these.
3. Pairs within RADIUS bits are verified exactly: weighted Jaccard of the shingle multisets, at least `percent`.

What this can lose: pairs at the threshold whose fingerprints differ in more than RADIUS bits, about one in two
thousand of those at 0.8 exactly (a bit differs with probability 0.15), and fewer above. Windows of a length meet
items of that length in work that is the product of the two, divided by little, as blocks this narrow select little;
the windows that step 1 leaves grow with the passages found, not with the corpus.

Defined cases: null or wordless documents and items match nothing; a document shorter than an item is compared as far
as it goes, and so is its end; very long texts are slid over whole; repeated rows are reported once for each (doc_id,
item_id, start); of several texts under one item id the most similar is told; empty tables give an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import staged

WORDS = 5
PERCENT = 80
RADIUS = 19
#: Rows of 20 to 30 bytes that may be broadcast; larger tables are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Features whose votes 16-bit counters hold.
LANE = (1 << 16) - 1


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has few enough rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def bind(value: Column, body) -> Column:
    """body(x) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    normal = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(normal) > 0, F.split(normal, " ")).otherwise(F.array().cast("array<string>"))


def shingle_count(words: Column) -> Column:
    """Shingles of a window of so many words."""
    return F.greatest(words - (WORDS - 1), F.lit(1))


def needed(own: Column, other: Column, percent: int) -> Column:
    """Common features that two sets of these sizes need."""
    return F.ceil((F.lit(percent) * (own + other)) / F.lit(100 + percent)).cast("int")


def _positions(words: DataFrame, *keep: str) -> DataFrame:
    """keep, pos (from 0), gram (64-bit hash) of every shingle; the words of short rows are one."""
    n = F.size("w")
    m = F.greatest(n - (WORDS - 1), F.lit(0))
    names = [f"w{k}" for k in range(WORDS)]
    long = F.arrays_zip(*(F.slice("w", k + 1, m).alias(name) for k, name in enumerate(names)))
    # Nulls don't change a hash, so a short row's only shingle is hashed as its joined words.
    short = F.array(F.struct(F.concat_ws(" ", "w").alias(names[0]), *(F.lit(None).cast("string").alias(name) for name in names[1:])))
    zipped = F.when(n >= WORDS, long).when(n > 0, short)
    return words.select(*keep, F.posexplode(zipped).alias("pos", "g")).select(*keep, "pos", F.xxhash64(*(F.col(f"g.{name}") for name in names)).alias("gram"))


def _short_positions(words: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """_positions of a document, and its shingles of each of the lengths below five."""
    out = _positions(words, *keep)
    for n in lengths:
        grams = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.concat_ws(" ", F.slice("w", i, F.lit(n)))))  # noqa: B023
        # A document of this very length has it from _positions.
        out = out.unionByName(words.select(*keep, F.posexplode(F.when(F.size("w") > n, grams)).alias("pos", "gram")))
    return out


def gram_hashes(words: Column) -> Column:
    """Hashes of a word array's shingles, as in _positions."""
    each = F.transform(
        F.sequence(F.lit(1), F.size(words) - (WORDS - 1)),
        lambda i: F.xxhash64(*(F.element_at(words, (i + k).cast("int")) for k in range(WORDS))),
    )
    return F.when(F.size(words) >= WORDS, each).otherwise(F.array(F.xxhash64(F.concat_ws(" ", words))))


def features(grams: Column) -> Column:
    """Distinct hashes that stand for a multiset: the first of equal grams is itself, the others are hashed with their number."""

    def numbered(x: Column) -> Column:
        return F.transform(x, lambda g, i: bind(i - F.array_position(x, g).cast("int") + 1, lambda k: F.when(k == 0, g).otherwise(F.xxhash64(g, k))))

    return bind(grams, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), x).otherwise(bind(F.sort_array(x), numbered)))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash: a bit is set where more of the hashes have it than not.

    A sum counts several bits at a time, in lanes of 16 bits; more than LANE hashes are counted in lanes of 32.
    """
    total = F.size(hashes)
    none = F.lit(0).cast("long")

    def joined(width: int) -> Column:
        mask = sum(1 << at for at in range(0, 64, width))
        sums = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda s: F.aggregate(hashes, none, lambda t, h: t + F.call_function("shiftrightunsigned", h, s).bitwiseAND(F.lit(mask))))

        def bits(x: Column) -> Column:
            count = lambda j: F.call_function("shiftrightunsigned", F.element_at(x, j % width + 1), j - j % width).bitwiseAND(F.lit((1 << width) - 1))
            bit = lambda j: F.when(2 * count(j) > total, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(none)
            return F.aggregate(F.sequence(F.lit(0), F.lit(63)), none, lambda t, j: t.bitwiseOR(bit(j)))

        return bind(sums, bits)

    return F.when(total <= LANE, joined(16)).otherwise(joined(32))


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """radius + 1 structs (block, value) that together hold all bits."""
    at, out = 0, []
    for k, width in enumerate(_widths(radius)):
        value = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1))
        out.append(F.struct(F.lit(k).alias("block"), value.alias("value")))
        at += width
    return F.array(*out)


def _widths(radius: int) -> list[int]:
    return [64 // (radius + 1) + (k < 64 % (radius + 1)) for k in range(radius + 1)]


def _first_equal(difference: Column, radius: int) -> Column:
    """The first block in which two fingerprints are equal, from their XOR; null if there is none."""
    at, out = 0, []
    for k, width in enumerate(_widths(radius)):
        out.append(F.when(F.shiftrightunsigned(difference, at).bitwiseAND(F.lit((1 << width) - 1)) == 0, F.lit(k)))
        at += width
    return F.coalesce(*out)


def _starts(hits: DataFrame, percent: int) -> DataFrame:
    """(key, n, starts) from hits (key, size, n, pos): where a window of n words has shingles enough of items of that length."""
    m = shingle_count(F.col("n"))
    placed = hits.groupBy("key", "size", "n").agg(F.array_sort(F.collect_set("pos")).alias("p")).withColumns({"m": m, "full": needed(m, m, percent), "cut": F.ceil(F.lit(percent) * m / 100).cast("int")})
    at = lambda i: F.element_at("p", (i + 1).cast("int"))
    last = F.size("p") - 1

    def span(lo: Column, hi: Column) -> Column:
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    # Whole windows hold `full` hits in a row within their shingles; those that the document's end cuts, `cut` to the end.
    whole = F.transform(F.sequence(F.lit(0), F.size("p") - F.col("full")), lambda i: span(F.greatest(at(i + F.col("full") - 1) - F.col("m") + 1, F.lit(0)), F.least(at(i), F.col("size") - F.col("n"))))
    whole = F.when(F.size("p") >= F.col("full"), F.flatten(whole)).otherwise(F.array().cast("array<int>"))
    end = F.when(F.size("p") >= F.col("cut"), span(F.greatest(F.col("size") - F.col("n") + 1, F.lit(0)), at(last + 1 - F.col("cut")))).otherwise(F.array().cast("array<int>"))
    return placed.select("key", "n", F.array_distinct(F.concat(whole, end)).alias("starts")).where(F.size("starts") > 0)


def leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start (word), n_words, distance (bits) and similarity of every leaked passage."""
    own = items.select(F.col(item).cast("long").alias("item_id"), word_array(F.col(item_text)).alias("w"), F.size(word_array(F.col(item_text))).alias("n"))
    own = staged(own.where("n > 0").dropDuplicates().select("item_id", "n", "w", features(gram_hashes(F.col("w"))).alias("item_features")), "decon-items")
    lengths = staged(_positions(own, "n").select("gram", "n").distinct(), "decon-grams")
    keyed = docs.select(F.xxhash64(F.col(key).cast("long"), F.col(text)).alias("key"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    words = keyed.select("key", word_array(F.col("text")).alias("w")).withColumn("size", F.size("w"))
    short = [r.n for r in own.where(F.col("n") < WORDS).select("n").distinct().collect()]
    hits = _short_positions(words, short, "key", "size").join(bounded_broadcast(lengths, lengths.count()), "gram").select("key", "size", "n", "pos")
    found = _starts(hits, percent).groupBy("key").agg(F.collect_list(F.struct("n", "starts")).alias("windows"))
    found = staged(found, "decon-windows")
    texts = keyed.join(bounded_broadcast(found, found.count()), "key").select("doc_id", word_array(F.col("text")).alias("w"), "windows")
    by_length = texts.select("doc_id", "w", F.explode("windows").alias("x")).select("doc_id", "w", F.col("x.n").alias("n"), F.explode("x.starts").alias("start"))
    cut = by_length.select("doc_id", "start", "n", F.expr("slice(w, start + 1, n)").alias("w"))
    marked = staged(cut.select("doc_id", "start", "n", F.size("w").alias("n_words"), features(gram_hashes(F.col("w"))).alias("features")), "decon-cut")
    one = marked.withColumn("f", simhash(F.col("features"))).withColumn("b", F.explode(blocks(F.col("f"), radius))).withColumns({"block": F.col("b.block"), "value": F.col("b.value")})
    other = own.select("item_id", "n", "item_features", simhash(F.col("item_features")).alias("item_f"))
    other = other.withColumn("b", F.explode(blocks(F.col("item_f"), radius))).select("item_id", "n", "item_features", "item_f", F.col("b.block").alias("block"), F.col("b.value").alias("value"))
    # The items' features are broadcast: rows of 8 bytes a word, whose number is checked by the words of all blocks.
    size = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * (radius + 1) // 3
    met = one.join(bounded_broadcast(other, size), ["n", "block", "value"]).withColumn("x", F.col("f").bitwiseXOR(F.col("item_f")))
    met = met.where((F.bit_count("x") <= radius) & (_first_equal(F.col("x"), radius) == F.col("block")))
    scored = met.withColumn("both", F.size(F.array_intersect("features", "item_features"))).withColumn("either", shingle_count(F.col("n_words")) + shingle_count(F.col("n")) - F.col("both"))
    kept = scored.where(100 * F.col("both") >= percent * F.col("either")).select("doc_id", "item_id", "start", F.struct((F.col("both") / F.col("either")).alias("similarity"), "n_words", F.bit_count("x").alias("distance")).alias("s"))
    return kept.groupBy("doc_id", "item_id", "start").agg(F.max("s").alias("s")).select("doc_id", "item_id", "start", "s.n_words", "s.distance", "s.similarity")


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs in which no passage of an item is found."""
    bad = staged(leaks(docs, items, **options).select(F.col("doc_id").alias("_bad")).distinct(), "decon-bad")
    bad = bounded_broadcast(bad, bad.count())
    return docs.join(bad, F.col(options.get("key", "doc_id")).cast("long").eqNullSafe(F.col("_bad")), "left_anti")
