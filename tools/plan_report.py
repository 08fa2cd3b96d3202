"""Summarise the physical plan of every registered query.

usage: python tools/plan_report.py [sf_dir] > PLANS.md

Counts shuffles (``Exchange``), broadcasts, sort-merge / broadcast-hash
joins, windows and scans, and lists the filters pushed into parquet scans.
Tables that a query writes while it is built (``session.materialize``:
admission rounds, batches that several outputs read) are counted too, in the
``tables`` column and in all sums; writers and streams are reported with the plan of
their final DataFrame.
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(plan: str) -> dict:
    tree = plan.split("\n\n")[0]
    nodes = re.findall(r"(?:\+- |:- |^)([A-Za-z]+(?: [A-Za-z]+)*)\s+\(\d+\)", tree, re.M)
    names = [n.strip() for n in nodes]
    pushed = sorted(set(p for p in re.findall(r"PushedFilters: \[(.*?)\]", plan) if p))
    return {
        "shuffles": sum(1 for n in names if n == "Exchange"),
        "broadcasts": sum(1 for n in names if n == "BroadcastExchange"),
        "smj": sum(1 for n in names if n.startswith("SortMergeJoin")),
        "bhj": sum(1 for n in names if n.startswith("BroadcastHashJoin")),
        "windows": sum(1 for n in names if n in ("Window", "WindowGroupLimit")),
        "scans": sum(1 for n in names if n.startswith("Scan")),
        "pushed": pushed,
    }


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from storelake import session
    from storelake.session import checkpoint_dir, get_session
    written: list[str] = []
    plain = session.materialize

    def text(df) -> str:
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain("formatted")
        return buf.getvalue()

    def counted(df, name="stage"):
        written.append(text(df))
        return plain(df, name)

    session.materialize = counted        # before the operators import it
    from storelake.plans.registry import load_all
    spark = get_session("local[8]", 8)
    checkpoint_dir(spark)
    print(f"# Physical plans at {sf_dir}\n")
    print("Shuffle = `Exchange` (hash/range), broadcasts are chosen by the planner's size "
          "check.\n")
    print("| query | tables | shuffles | broadcasts | SMJ | BHJ | windows | scans | pushed filters |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, reg in sorted(load_all().items()):
        written.clear()
        final = text(reg.build(spark, sf_dir))
        parts = [summarise(p) for p in [final, *written]]
        pushed = "; ".join(sorted({p for x in parts for p in x["pushed"]}))[:160]
        sums = [str(sum(x[k] for x in parts)) for k in ("shuffles", "broadcasts", "smj", "bhj", "windows", "scans")]
        print(f"| {name} | {len(written)} | {' | '.join(sums)} | {pushed} |")


if __name__ == "__main__":
    main(sys.argv)
