"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a reject condition on metrics of a text. A sample of the table tells each metric's cost (seconds of the
sample beyond a bare scan, the least of some runs) and each row's verdict by each rule. The cascade then takes, again
and again, the rule with most rejections for its cost: rejections among the sampled rows that no earlier rule rejects,
cost of those metrics that no earlier rule and no result needs anyway. An expensive rule so runs only on rows that the
cheaper, sharper ones let through. The order changes speed and the reported first rule, never the verdict.

Defined cases: a null text counts as empty (no words, so it fails `few_words`); a very long text is judged whole; an
empty table gives an empty result and the rules' listed order; repeated ids are judged row by row; extra columns pass
through, and the columns that this module adds replace none (a clash raises ValueError).
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import SEPARATOR_CLASS, SEPARATORS, staged

#: Rows that the cost and selectivity estimate reads, and how often each cost is measured.
SAMPLE_ROWS, RUNS = 2000, 3
SYMBOLS = "#*$%&|<>"
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """name: of the rule. rejects: builds the reject condition from a table's metric columns by name."""

    name: str
    rejects: object


def bind(value: Column, body) -> Column:
    """body(x) with value evaluated once, whatever number of times body uses x."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _deleted(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def word_array(text: Column) -> Column:
    """Words of a text; an empty array without any."""
    trimmed = F.trim(text, F.lit(SEPARATORS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, f"{SEPARATOR_CLASS}+")).otherwise(F.array().cast("array<string>"))


def word_chars(text: Column) -> Column:
    return F.length(_deleted(text, SEPARATORS)).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(_deleted(text, SYMBOLS))).cast("long")


def n_upper(text: Column) -> Column:
    return (F.length(text) - F.length(_deleted(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).cast("long")


def lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.length(F.trim(line, F.lit(SEPARATORS))) > 0)


def n_dup_lines(text: Column) -> Column:
    return bind(lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    The windows are sorted with their positions, so equal ones are neighbours: n log n for any text. Positions of
    repeated windows then cover min(3, gap to the next) words each.
    """

    def marked(sorted_windows: Column) -> Column:
        pairs = F.zip_with(
            sorted_windows,
            F.slice(sorted_windows, 2, F.greatest(F.size(sorted_windows) - 1, F.lit(0))),
            lambda a, b: F.when((a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"]), F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>")),
        )
        return F.sort_array(F.array_distinct(F.flatten(pairs)))

    def windows(w: Column) -> Column:
        m = F.size(w) - (WINDOW - 1)
        return F.sort_array(F.arrays_zip(F.slice(w, 1, m).alias("a"), F.slice(w, 2, m).alias("b"), F.slice(w, 3, m).alias("c"), F.sequence(F.lit(1), m).alias("p")))

    def covered(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.lit(WINDOW), b - a))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    return bind(words, lambda w: F.when(F.size(w) > WINDOW, bind(bind(windows(w), marked), covered)).otherwise(F.lit(0).cast("long")))


#: Name, metric of a text (or of its words), and what it depends on.
METRICS = {
    "n_words": lambda text: F.size(word_array(text)).cast("long"),
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": lambda text: n_repeat_words(word_array(text)),
    "n_lines": lambda text: F.size(lines(text)).cast("long"),
    "n_upper": n_upper,
}

#: The metrics that quality_report returns.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The contract's base.
BASE_RULES = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
)
#: The method's own rules, all gentle: clean prose of any language passes.
RULES = (
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("duplicate_lines", lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    Rule("shouting", lambda m: 10 * m("n_upper") > 3 * m("word_chars")),
    Rule("short_words", lambda m: m("word_chars") < 2 * m("n_words")),
    Rule("long_words", lambda m: m("word_chars") > 20 * m("n_words")),
)


def sampled(df: DataFrame, text: str, rows: int) -> DataFrame:
    """Written texts of about so many rows drawn from the whole table."""
    count = df.count()
    drawn = df if count <= rows else df.sample(1.2 * rows / count, 1)
    return staged(drawn.select(F.coalesce(F.col(text), F.lit("")).alias("_text")).limit(rows), "rules-sample")


def needs(rule: Rule) -> list[str]:
    """Names of the metrics that a rule asks for."""
    asked: list[str] = []

    def metric(name: str) -> Column:
        asked.append(name)
        return F.lit(0)

    rule.rejects(metric)
    return list(dict.fromkeys(asked))


def estimate(df: DataFrame, text: str, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> dict:
    """Over a sample: seconds of each metric, metrics of each rule, and (verdicts of all rules, rows) with that pattern.

    Only counts of the verdicts' patterns reach the driver. The estimate steers order alone, so an unlucky sample
    costs time, not correctness.
    """
    rows = sampled(df, text, sample_rows)
    value = F.col("_text")

    def seconds(column: Column) -> float:
        best = float("inf")
        for _ in range(RUNS):
            began = time.perf_counter()
            rows.agg(F.sum(column)).collect()
            best = min(best, time.perf_counter() - began)
        return best

    asked = {r.name: needs(r) for r in rules}
    bare = seconds(F.length(value))
    costs = {m: max(seconds(METRICS[m](value)) - bare, 0.0) for m in dict.fromkeys(m for names in asked.values() for m in names)}
    flags = [F.coalesce(r.rejects(lambda name: METRICS[name](value)), F.lit(True)).alias(r.name) for r in rules]
    patterns = [(tuple(p)[:-1], p["_n"]) for p in rows.select(*flags).groupBy(*(r.name for r in rules)).agg(F.count("*").alias("_n")).collect()] if rules else []
    return {"costs": costs, "needs": asked, "patterns": patterns}


def ordered(rules: Sequence[Rule], found: dict, known: Sequence[str] = ()) -> list[Rule]:
    """Rules by falling rejection per cost, of what is left after those before; ties keep the listed order.

    known: metrics that are computed for all rows anyway and so cost nothing.
    """
    left, patterns, have, out = list(enumerate(rules)), found["patterns"], set(known), []
    while left:

        def worth(rule: tuple[int, Rule]) -> float:
            cost = 1e-4 + sum(found["costs"][m] for m in found["needs"][rule[1].name] if m not in have)  # noqa: B023
            return sum(n for flags, n in patterns if flags[rule[0]]) / cost  # noqa: B023

        best = max(left, key=worth)
        left.remove(best)
        out.append(best[1])
        have.update(found["needs"][best[1].name])
        patterns = [(flags, n) for flags, n in patterns if not flags[best[0]]]
    return out


def cascade(rules: Sequence[Rule], metric) -> Column:
    """Name of the first rule that rejects, or null. CASE stops at the first hit, so later metrics aren't computed."""
    out = None
    for rule in rules:
        hit = F.coalesce(rule.rejects(metric), F.lit(True))
        out = F.when(hit, F.lit(rule.name)) if out is None else out.when(hit, F.lit(rule.name))
    return out if out is not None else F.lit(None).cast("string")


def apply_rules(df: DataFrame, text: str = "text", rules: Sequence[Rule] = BASE_RULES + RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """df with `rejected_by` (first rule that rejects, null if kept); metrics are computed only as far as needed."""
    if "rejected_by" in df.columns:
        raise ValueError("the table already has a column rejected_by")
    value = F.coalesce(F.col(text), F.lit(""))
    order = ordered(rules, estimate(df, text, rules, sample_rows))
    return df.withColumn("rejected_by", cascade(order, lambda name: METRICS[name](value)))


def quality_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base metrics of every row, base_failed and kept.

    The base metrics are results, so they are computed for all rows and cost the cascade nothing; base rules and the
    method's own are one cascade, in the order that these marginal costs give.
    """
    every = (*BASE_RULES, *rules)
    order = ordered(every, estimate(df, text, every, sample_rows), RESULTS)
    value = F.coalesce(F.col(text), F.lit(""))
    words = word_array(value)
    measured = df.select(
        F.col(doc_id).alias("doc_id"),
        value.alias("_text"),
        bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), n_repeat_words(w).alias("n_repeat_words"))).alias("_w"),
    ).select(
        "doc_id",
        F.col("_w.n_words").alias("n_words"),
        word_chars(F.col("_text")).alias("word_chars"),
        n_symbols(F.col("_text")).alias("n_symbols"),
        n_dup_lines(F.col("_text")).alias("n_dup_lines"),
        F.col("_w.n_repeat_words").alias("n_repeat_words"),
        "_text",
    )
    failed = cascade(BASE_RULES, lambda name: F.col(name)).isNotNull()
    first = cascade(order, lambda name: F.col(name) if name in RESULTS else METRICS[name](F.col("_text")))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), first.isNull().alias("kept")
    )


#: DuckDB SQL of quality_report over documents.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE g.n > 1 GROUP BY doc_id),
m AS (
  SELECT t.doc_id, text, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l.l) - len(list_distinct(l.l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l.l) AS n_lines,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper
  FROM t JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 10 * n_upper > 3 * word_chars
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""
