"""Command line: build, export, query and eval.

python -m loomgraph.cli build --src DIR --out DIR [--lang go,ts,sol]
python -m loomgraph.cli export --graph DIR --out DIR
python -m loomgraph.cli query --graph DIR find-symbol|callers|callees|subgraph|search|context TEXT [--depth N]
python -m loomgraph.cli eval --tasks 'DIR/*.yaml' --answers FILE.jsonl --out DIR [--baselines alpha,delta]
python -m loomgraph.cli report --results FILE.csv
"""

from __future__ import annotations

import argparse
import json
import sys

from loomgraph.evaluate import BASELINES
from loomgraph.session import local_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomgraph")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("--src", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--lang", default="auto")
    x = sub.add_parser("export")
    x.add_argument("--graph", required=True)
    x.add_argument("--out", required=True)
    q = sub.add_parser("query")
    q.add_argument("--graph", required=True)
    q.add_argument("what", choices=["find-symbol", "callers", "callees", "subgraph", "search", "context"])
    q.add_argument("text")
    q.add_argument("--depth", type=int, default=1)
    e = sub.add_parser("eval")
    e.add_argument("--tasks", required=True)
    e.add_argument("--answers", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--baselines", default=",".join(BASELINES))
    r = sub.add_parser("report")
    r.add_argument("--results", required=True)
    a = p.parse_args(argv)
    spark = local_session()
    if a.command == "build":
        from loomgraph.pipeline import build

        print(json.dumps(build(spark, a.src, a.out, None if a.lang == "auto" else a.lang.split(",")), indent=2))
        return 0
    if a.command == "eval":
        from loomgraph.evaluate import load_tasks, report, run, write_csv

        # answers come from a file of JSON lines: task_id, baseline, output and token counts
        with open(a.answers, encoding="utf-8") as f:
            known = {(x["task_id"], x["baseline"]): x for x in map(json.loads, filter(str.strip, f))}
        got = run(spark, load_tasks(a.tasks), lambda t, b: known[t.id, b], a.baselines.split(","))
        write_csv(got, a.out)
        print(report(got))
        return 0
    if a.command == "report":
        from loomgraph.evaluate import RESULT_DDL, report

        print(report(spark.read.schema(RESULT_DDL).csv(a.results, header=True)))
        return 0
    from loomgraph.api import Graph

    g = Graph(spark, a.graph)
    if a.command == "export":
        g.export(a.out)
        return 0
    if a.what == "context":
        print(json.dumps(g.context_for_task(a.text), indent=2, ensure_ascii=False))
        return 0
    got = {"find-symbol": lambda: g.find_symbol(a.text, exact=False), "callers": lambda: g.find_callers(a.text, a.depth)[0], "callees": lambda: g.find_callees(a.text, a.depth)[0], "subgraph": lambda: g.get_subgraph(a.text, a.depth)[0], "search": lambda: g.search_text(a.text)}[a.what]()
    for row in got.toLocalIterator():
        print(json.dumps(row.asDict(), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
