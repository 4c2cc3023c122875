"""Personal data: generators of candidate spans, boosted trees that judge them, calibrated thresholds that select.

Base spans (email, ip, card, phone) are fixed patterns with fixed tests. High-recall generators propose further,
overlapping spans of the same kinds: numbers that the base's greedy patterns run together or reject as a whole, other
phone formats, obfuscated emails. Each candidate gets features of its format and context; the trees' log odds must reach
its kind's threshold, calibrated on held-out rows for `PRECISION`. Selected spans that overlap a base span of their kind
are dropped, of the others the leftmost stays.

The trees learn on the driver from `TRAIN_ROWS` candidates that this module makes up from formats (no corpus text), a
bound that no data changes; on the tables all is DataFrame functions, a row at a time, without shuffle.

Patterns have no nested unbounded groups that backtrack, so a text of any length needs no deep regex stack. Parts of an
address have any length; a card number has 13 to 19 digits by its standard, other runs of digits are no candidates.

Defined cases: a null text is empty, without spans; repeated ids are judged row by row; an empty table gives an empty
result; spans are code-point offsets, end exclusive; very long texts are searched whole; extra columns are ignored by
`spans_report` and kept by `redact`, and a column that is named like the one added (_spans, _pii) raises ValueError.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.llm import boosting

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base; possessive where the contract's form needs no backtracking.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Candidate generators, as (kind, pattern).
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]++ ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,}+(?![A-Za-z0-9-])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"),
    ("card", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ .-][0-9]{4}){3}|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"),
    ("phone", r"(?<![0-9+.])\+?[0-9]{0,3}[ .-]?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
)
CARD_DIGITS, PHONE_DIGITS = (14, 19), (10, 15)
TRAIN_ROWS = 4000
PRECISION = 0.98
CONTEXT = 24
GOOD_WORDS = "phone|tel|call|fon|mobil|card|visa|mail|contact|ip|host|addr"
BAD_WORDS = "version|order|ref|isbn|token|serial|invoice|id:|no\\.|part"
FEATURES = ("kind", "digits", "luhn", "octet", "before", "after", "plus", "marks", "distinct", "good", "bad", "style", "lead", "bracket")


def luhn_sum(number: str) -> int:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total


def _side(c: str) -> int:
    return 0 if c in ("", " ", "\n", "\t", "\r") else 2 if re.match(r"[A-Za-z0-9+@.]", c) else 1


def features(kind: str, span: str, before: str, after: str) -> list[int]:
    """The features of a candidate; before and after are its context, features_sql the same in SQL."""
    digits = re.sub("[^0-9]", "", span)
    octets = [int(p[:3] or 0) for p in span.split(".")] if kind == "ip" else [0]
    return [
        KINDS.index(kind),
        len(digits),
        int(kind == "card" and luhn_sum(digits) % 10 == 0),
        max(octets),
        _side(before[-1:]),
        _side(after[:1]),
        int(span.startswith("+")),
        len(span) - len(re.sub("[ ().-]", "", span)),
        len(set(digits)),
        int(re.search(GOOD_WORDS, before.lower()) is not None),
        int(re.search(BAD_WORDS, before.lower()) is not None),
        2 if re.search(r"\(at\)|\[at\]|\(dot\)|\[dot\]", span) else 1 if "@" in span and " " not in span else 0,
        int(digits[0]) if digits else -1,
        int("(" in span and ")" in span),
    ]


def made_up(rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of candidates made from formats."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 8)))

    def card(valid: bool) -> str:
        body = r.choice("23456") + d(14)
        check = (-luhn_sum(body + "0")) % 10
        return body + str(check if valid else (check + r.randint(1, 9)) % 10)

    x, y = [], []
    for _ in range(rows):
        kind, true = r.choice(KINDS), r.random() < 0.5
        before, after = f"{w()} {w()} ", r.choice([" ", " ", ".", ",", "\n", ""]) + w()
        if r.random() < 0.2:
            before += r.choice(["phone ", "call ", "mail ", "card ", "ip ", "tel: "] if true else ["version ", "order ", "ref ", "serial ", "invoice ", "no. "])
        if kind == "card":
            span = card(true) if r.random() < 0.8 else d(16)
            true = true and luhn_sum(span) % 10 == 0 and "version" not in before
            if r.random() < 0.4:
                span = r.choice(" -").join(span[k : k + 4] for k in range(0, 16, 4))
            if not true and r.random() < 0.2:
                span = d(13)
        elif kind == "phone":
            area, mid, end = d(3), d(3), d(4)
            span = r.choice([f"+{d(r.randint(1, 2))} ({area}) {mid}-{end}", f"+{d(1)}-{area}-{mid}-{end}", f"+{d(2)} {area} {mid} {end}", f"({area}) {mid}-{end}"])
            if not true:
                span = r.choice([f"{area} {mid} {end}", f"{area}.{mid}.{end}", f"{d(2)} {area}.{mid} {end}"])
                before += r.choice(["", "1", "x", "-", "$"])
        elif kind == "ip":
            span = ".".join(str(r.randint(1, 255)) for _ in range(4)) if true else ".".join(str(r.choice([r.randint(0, 9), r.randint(256, 999)])) for _ in range(4))
            if not true:
                before += r.choice(["version ", "v", "", "version "])
                true = max(map(int, span.split("."))) < 256 and re.search(BAD_WORDS, before) is None and not before.endswith("v")
        else:
            span = r.choice([f"{w()}@{w()}.com", f"{w()} (at) {w()} (dot) com", f"{w()}[at]{w()}[dot]org", f"{w()}@{w()} (dot) net"]) if true else r.choice([f"{w()} @ {w()}. {w()}", f"{w()} @ {w()} .{w()}", f"{w()} @{w()}. {w()}"])
        x.append(features(kind, span, before, after))
        y.append(int(true))
    return np.array(x), np.array(y)


@functools.cache
def model() -> tuple[tuple[boosting.Tree, ...], tuple[float, ...]]:
    """The trees, and the threshold of each kind."""
    x, y = made_up(TRAIN_ROWS, 1)
    trees = boosting.boost(x, y)
    x, y = made_up(TRAIN_ROWS, 2)
    scores = boosting.total(trees, x)
    return tuple(trees), tuple(boosting.threshold(scores[x[:, 0] == k], y[x[:, 0] == k], PRECISION) for k in range(len(KINDS)))


def bind(value: Column, body) -> Column:
    """body(x) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(number: Column) -> Column:
    """Whether a digit string (at most 19 digits are ever asked for) passes Luhn."""
    turned = F.reverse(number)
    value = lambda i: F.substr(F.when(i % 2 == 1, turned).otherwise(F.translate(turned, "0123456789", "0246813579")), i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda t, i: t + value(i))
    return F.coalesce(total % 10 == 0, F.lit(False))


def _passes(kind: str, span: Column) -> Column:
    digits, count = _digits(span), F.length(_digits(span))
    if kind == "ip":
        return F.forall(F.split(span, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.concat(F.lit("0"), F.ltrim(p, F.lit("0")))).cast("int") <= 255))
    if kind == "card":
        return F.when(count.between(*CARD_DIGITS), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return count.between(*PHONE_DIGITS)
    return F.lit(True)


_SPANS = "array<struct<start:int,kind:int,end:int,span:string>>"


def found(text: Column, kind: str, pattern: str, keep) -> Column:
    """Spans of a pattern's matches that keep(span) accepts; offsets come from the lengths of gaps and matches."""
    number = KINDS.index(kind)

    def located(x: Column) -> Column:
        pairs = F.arrays_zip(F.slice(x["gaps"], 1, F.size(x["hits"])).alias("gap"), x["hits"].alias("hit"))

        def step(state: Column, pair: Column) -> Column:
            start = state["at"] + F.length(pair["gap"])
            end = start + F.length(pair["hit"])
            one = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), pair["hit"].alias("span"))).cast(_SPANS)
            return F.struct(end.alias("at"), F.when(keep(pair["hit"]), F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

        first = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
        return F.aggregate(pairs, first, step, lambda s: s["out"])

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits"))
    return bind(parts, located)


#: What a text must hold for a kind's pattern of BASE (with its digits) or of GENERATORS to match; cheaper than these.
def _may_hold(text: Column, kind: str, base: bool) -> Column:
    if kind == "email":
        return text.contains("@") | F.lower(text).contains("(at)") | F.lower(text).contains("[at]")
    if kind == "phone" and base:
        return text.rlike(r"\+[0-9][ ().0-9-]{%d}" % (PHONE_DIGITS[0] - 1))
    return text.rlike({"ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9 .-]{12}", "phone": r"[0-9][ ().-]{0,3}[0-9][ ().-]{0,3}[0-9][ ().0-9-]{4}"}[kind])


def base_spans(text: Column) -> Column:
    none = F.array().cast(_SPANS)
    return F.concat(*(F.when(_may_hold(text, k, True), found(text, k, BASE[k], lambda s, k=k: _passes(k, s))).otherwise(none) for k in KINDS))


def features_sql(c: Column, text: Column) -> Column:
    """Struct of a candidate's features."""
    span, kind, digits = c["span"], c["kind"], _digits(c["span"])
    first = F.greatest(c["start"] - (CONTEXT - 1), F.lit(1))
    before = F.lower(F.substr(text, first, c["start"] - first + 1))
    near = lambda at: F.when((at < 1) | (F.length(F.substr(text, at, F.lit(1))) == 0) | F.substr(text, at, F.lit(1)).isin(" ", "\n", "\t", "\r"), 0).when(F.substr(text, at, F.lit(1)).rlike(r"[A-Za-z0-9+@.]"), 2).otherwise(1)
    octets = F.transform(F.split(span, r"\."), lambda p: F.coalesce(F.substring(p, 1, 3).try_cast("int"), F.lit(0)))
    values = {
        "kind": kind,
        "digits": F.length(digits),
        "luhn": F.when((kind == KINDS.index("card")) & _luhn(digits), 1).otherwise(0),
        "octet": F.when(kind == KINDS.index("ip"), F.array_max(octets)).otherwise(0),
        "before": near(c["start"]),
        "after": near(c["end"] + 1),
        "plus": F.when(span.startswith("+"), 1).otherwise(0),
        "marks": F.length(span) - F.length(F.translate(span, " ().-", "")),
        "distinct": F.size(F.array_distinct(F.filter(F.split(digits, ""), lambda d: d != ""))),
        "good": F.when(before.rlike(GOOD_WORDS), 1).otherwise(0),
        "bad": F.when(before.rlike(BAD_WORDS), 1).otherwise(0),
        "style": F.when(span.rlike(r"\(at\)|\[at\]|\(dot\)|\[dot\]"), 2).when(span.contains("@") & ~span.contains(" "), 1).otherwise(0),
        "lead": F.when(F.length(digits) > 0, F.substring(digits, 1, 1).try_cast("int")).otherwise(-1),
        "bracket": F.when(span.contains("(") & span.contains(")"), 1).otherwise(0),
    }
    return F.struct(*(values[n].cast("int").alias(n) for n in FEATURES))


def _tree_column(tree: boosting.Tree, f: Column) -> Column:
    if tree.feature < 0:
        return F.lit(tree.value)
    return F.when(f[FEATURES[tree.feature]] <= tree.threshold, _tree_column(tree.left, f)).otherwise(_tree_column(tree.right, f))


def _judge(text: Column, base: Column, trees, number: int, limit: float):
    """The test of a candidate of a kind."""

    def fits(c: Column) -> Column:
        score = bind(features_sql(c, text), lambda f: sum((_tree_column(t, f) for t in trees), F.lit(0.0)))
        met = F.exists(base, lambda b: (b["kind"] == number) & (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return ~met & (score >= limit - 1e-9)

    return fits


def _of_kind(number: int):
    return lambda s: s["kind"] == number


def selected_spans(text: Column, base: Column) -> Column:
    """Candidates at or above their kind's threshold, without those that overlap base or an earlier one of their kind."""
    trees, limits = model()
    none = F.array().cast(_SPANS)
    out = none
    for kind, pattern in GENERATORS:
        number = KINDS.index(kind)
        limit = limits[number]
        if limit == float("inf"):
            continue

        chosen = F.filter(found(text, kind, pattern, lambda s: F.lit(True)), _judge(text, base, trees, number, limit))
        out = F.concat(out, F.when(_may_hold(text, kind, False), chosen).otherwise(none))
    return out


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_spans(df: DataFrame, text: str = "text", out: str = "_spans") -> DataFrame:
    """df with a struct column: base and added, arrays of (start, kind number, end, span)."""
    if out in df.columns:
        raise ValueError(f"the table already has a column {out}")
    value = F.coalesce(F.col(text), F.lit(""))
    both = bind(value, lambda t: bind(base_spans(t), lambda b: F.struct(b.alias("base"), selected_spans(t, b).alias("added"))))
    none = F.struct(F.array().cast(_SPANS).alias("base"), F.array().cast(_SPANS).alias("added"))
    return df.withColumn(out, F.when(value.rlike(r"[0-9@]|\(at\)|\[at\]"), both).otherwise(none))


def spans_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base counts by kind, base_sha256 and all spans of every row."""
    marked = with_spans(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "_spans")
    base = F.col("_spans.base")
    counts = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return marked.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat(base, F.col("_spans.added"))).alias("spans"))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with each span of text replaced by <KIND>; of overlapping spans the first, or the longer, names the whole."""
    marked = with_spans(df, text, "_pii")
    spans = F.concat(F.col("_pii.base"), F.col("_pii.added"))
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def cut(t: Column) -> Column:
        def step(state: Column, s: Column) -> Column:
            end, inside = -s["back"], s["start"] < state["at"]
            gap = F.substr(t, state["at"] + 1, s["start"] - state["at"])
            return F.struct(
                F.greatest(state["at"], end).alias("at"),
                F.when(inside, state["out"]).otherwise(F.concat(state["out"], F.array(gap, F.element_at(names, s["kind"] + 1)))).alias("out"),
            )

        done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)
        return bind(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substr(t, d["at"] + 1, F.length(t))))

    return marked.withColumn(text, F.when(F.size(spans) > 0, bind(F.col(text), cut)).otherwise(F.col(text))).select(*df.columns)
