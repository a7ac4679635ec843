"""Command line: python -m barwright QUERY --data DIR [--limit N] [--out PATH] [--dry-run]."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from .plans import catalogue, report
from .session import build_session


def arguments(args: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="barwright", description="Runs a query of the catalogue and shows its first rows or writes all of them.")
    p.add_argument("query", choices=sorted(catalogue.QUERIES))
    p.add_argument("--data", required=True, help="folder with the tables")
    p.add_argument("--limit", type=int, default=20, help="rows to show")
    p.add_argument("--out", help="folder to write all rows to, a JSON object a line")
    p.add_argument("--jobs", type=int, help="local cores; unset: the cluster that spark-submit names")
    p.add_argument("--dry-run", action="store_true", help="show the plan only")
    return p.parse_args(args)


def main(args: Sequence[str] | None = None) -> int:
    a = arguments(args)
    spark = build_session("barwright", f"local[{a.jobs}]" if a.jobs else None)
    df = catalogue.QUERIES[a.query](spark, a.data)
    if a.dry_run:
        df.explain("formatted")
    elif a.out:
        df.write.mode("errorifexists").json(a.out)
    else:
        print(report.console(a.query, df.limit(a.limit)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
