"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, cls string, n int, w string, score2 double, root string"


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abdeimnorstu") for _ in range(r.randint(2, 7))) for _ in range(n))


def texts(seed: int = 7) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    base = [words(r, n) for n in (60, 80, 120, 200, 300)]
    passage = words(r, 70)
    out: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two"), (6, "One TWO")]
    n = 10
    for b in base:
        out += [(n, b), (n + 1, b), (n + 2, b.upper())]
        parts = b.split()
        for k in range(3):
            changed = list(parts)
            changed[r.randrange(len(parts))] = f"changed{k}"
            out.append((n + 3 + k, " ".join(changed)))
        out.append((n + 6, f"{words(r, 40)}\n{passage}\n{words(r, 30 + n)}"))
        n += 10
    out += [(90, "x" * 1000), (91, "ab" * 700), (92, "ž😀 " * 300), (93, words(r, 20_000)), (94, "\n".join(["same line here"] * 30)), (95, "na*** no### $$$ " * 40)]
    out += [(96, base[0]), (96, base[0]), (97, base[1] + " more"), (97, words(r, 90)), (None, base[2]), (None, words(r, 55))]
    return out


def frame(spark, rows):
    full = [(i, t, "en", "s", len(t or ""), "k", "c", 1, "w", 0.5, "r") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
