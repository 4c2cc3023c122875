"""Command line: strataline export|reconstruct|verify|quality SOURCE OUTPUT [options], or one console script each. Exit codes 0, 1 (failed), 2 (warnings)."""

from __future__ import annotations

import argparse
import sys

from strataline import api
from strataline.plans import model


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strataline")
    runs = top.add_subparsers(dest="run", required=True)
    p = {name: runs.add_parser(name) for name in ("export", "reconstruct", "verify", "quality")}
    for q in p.values():
        q.add_argument("source")
        q.add_argument("output")
    e = p["export"]
    e.add_argument("--formats", default="", help="comma-separated; all formats if left out")
    e.add_argument("--memo", choices=("inline", "skip", "null"))
    e.add_argument("--strip-spaces", action="store_true")
    e.add_argument("--encoding", default="auto")
    e.add_argument("--decode-errors", default="strict", choices=("strict", "ignore", "replace"))
    e.add_argument("--deleted", default="skip", choices=("skip", "include", "separate"))
    e.add_argument("--missing-memo", default="fail", choices=("fail", "null-with-warning"))
    e.add_argument("--no-overwrite", dest="overwrite", action="store_false")
    e.add_argument("--no-validate", dest="validate", action="store_false")
    e.add_argument("--xlsx-long-text", default="overflow", choices=("overflow", "error"))
    e.add_argument("--incremental", action="store_true")
    r = p["reconstruct"]
    r.add_argument("--input-format", default="jsonl", choices=model.FORMATS)
    r.add_argument("--memo", default="inline", choices=("inline", "skip", "null"))
    r.add_argument("--overwrite", action="store_true")
    v = p["verify"]
    v.add_argument("--formats", default=",".join(model.FORMATS))
    v.add_argument("--no-strict", dest="strict", action="store_false")
    v.add_argument("--report")
    v.add_argument("--no-report", dest="write_report", action="store_false")
    q = p["quality"]
    q.add_argument("--overwrite", action="store_true")
    q.add_argument("--max-differences", type=int, default=20)
    return top


def main(argv: list[str] | None = None) -> int:
    given = vars(parser().parse_args(argv))
    if given.get("formats") == "":
        given["formats"] = model.FORMATS
    run = {"export": api.export_tables, "reconstruct": api.reconstruct_tables, "verify": api.verify_export, "quality": api.check_quality}[given.pop("run")]
    try:
        done = run(given.pop("source"), given.pop("output"), **given)
    except (ValueError, FileExistsError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    for r in done.results:
        print(f"{r.status:<12}{getattr(r, 'format', ''):<6} {r.table}")
        for text in r.errors[:5]:
            print(f"  error: {text}")
        for text in r.warnings[:3]:
            print(f"  warning: {text}")
    for text in done.warnings:
        print(f"warning: {text}")
    return done.exit_code


def export_main(argv: list[str] | None = None) -> int:
    return main(["export", *(sys.argv[1:] if argv is None else argv)])


def reconstruct_main(argv: list[str] | None = None) -> int:
    return main(["reconstruct", *(sys.argv[1:] if argv is None else argv)])


def verify_main(argv: list[str] | None = None) -> int:
    return main(["verify", *(sys.argv[1:] if argv is None else argv)])


def quality_main(argv: list[str] | None = None) -> int:
    return main(["quality", *(sys.argv[1:] if argv is None else argv)])


if __name__ == "__main__":
    sys.exit(main())
