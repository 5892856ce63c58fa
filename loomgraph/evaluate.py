"""Evaluation of retrieval strategies: tasks, scores, report.

Answers come from a callable (task, baseline) -> text and token counts, so no external service is
part of the library.
"""

from __future__ import annotations

import re
import sys
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.expr import extract_symbols, precision, recall, rubric_hit

BASELINES = ("alpha", "beta", "gamma", "delta")
RESULT_DDL = "task_id string, baseline string, input_tokens bigint, output_tokens bigint, cached_tokens bigint, score double, latency_ms bigint, num_tool_calls bigint, stale boolean"


@dataclass
class Task:
    id: str
    corpus: str = ""
    corpus_path: str = ""
    description: str = ""
    expected_kind: str = ""
    symbols: list[str] = field(default_factory=list)
    rubric: list[str] = field(default_factory=list)
    scoring: str = ""


def read_task(text: str) -> Task:
    """A task from the plain YAML that task files use: scalars, block texts and lists of texts."""
    flat: dict[str, object] = {}
    path: list[tuple[int, str]] = []
    lines = text.splitlines()
    i = 0
    while i < len(lines):
        raw = lines[i]
        i += 1
        if not raw.strip() or raw.strip().startswith("#"):
            continue
        ind = len(raw) - len(raw.lstrip())
        s = raw.strip()
        if s.startswith("- "):
            while path and path[-1][0] >= ind and not isinstance(flat.get(".".join(k for _, k in path)), list):
                path.pop()
            key = ".".join(k for _, k in path)
            items = flat.setdefault(key, [])
            if isinstance(items, list):
                items.append(s[2:].strip().strip("\"'"))
            continue
        m = re.match(r"([\w-]+):\s*(.*)$", s)
        if not m:
            raise ValueError(f"bad task line {raw!r}")
        while path and path[-1][0] >= ind:
            path.pop()
        path.append((ind, m.group(1)))
        key, v = ".".join(k for _, k in path), m.group(2)
        if v in ("|", "|-", ">", ">-"):
            block = []
            while i < len(lines) and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip()) > ind):
                block.append(lines[i].strip())
                i += 1
            flat[key] = ("\n" if v[0] == "|" else " ").join(block).strip()
        elif v:
            flat[key] = v.strip("\"'")
    text_of = lambda k: str(flat.get(k, ""))
    items_of = lambda k: list(flat[k]) if isinstance(flat.get(k), list) else []
    if not text_of("id"):
        raise ValueError("task without id")
    return Task(text_of("id"), text_of("corpus"), text_of("corpus_path"), text_of("description"), text_of("expected_kind"), items_of("expected.symbols"), items_of("expected.rubric"), text_of("scoring.type"))


def load_tasks(pattern: str) -> list[Task]:
    """Tasks of the files that a glob pattern names, in order of their paths."""
    p = Path(pattern)
    return [read_task(f.read_text(encoding="utf-8")) for f in sorted(p.parent.glob(p.name))]


def score_answers(answers: DataFrame) -> DataFrame:
    """``score`` for rows with output, scoring, symbols and rubric (arrays): the mean of precision and
    recall of dotted symbols, or the share of rubric lines met; 0 for any other scoring."""
    got = extract_symbols("output")
    pr = (precision(got, F.col("symbols")) + recall(got, F.col("symbols"))) / 2
    met = F.size(F.filter("rubric", lambda r: rubric_hit(F.col("output"), r)))
    rub = F.when(F.size("rubric") > 0, met / F.size("rubric")).otherwise(0.0)
    return answers.withColumn("score", F.when(F.col("scoring") == "precision_recall", pr).when(F.col("scoring") == "rubric", rub).otherwise(0.0))


def summary(results: DataFrame) -> DataFrame:
    """baseline, n, avg_input_tokens, avg_score, in the fixed order of baselines, others last."""
    per = results.groupBy("baseline").agg(F.count(F.lit(1)).alias("n"), F.avg("input_tokens").alias("avg_input_tokens"), F.avg("score").alias("avg_score"))
    rank = F.lit(len(BASELINES))
    for i, b in enumerate(BASELINES):
        rank = F.when(F.col("baseline") == b, i).otherwise(rank)
    return per.withColumn("ord", rank).orderBy("ord", "baseline").drop("ord")


def hypotheses(results: DataFrame) -> DataFrame:
    """One row, where alpha used tokens and delta ran: h1_saving, the percentage of input tokens that
    delta saves against alpha, and h2_difference, delta's mean score less alpha's, as numbers and text."""
    mean = lambda b, c: F.avg(F.when(F.col("baseline") == b, F.col(c)))
    per = results.agg(*[mean(b, c).alias(f"{b}_{k}") for b in ("alpha", "delta") for c, k in (("input_tokens", "t"), ("score", "s"))])
    kept = per.where("alpha_t > 0 and delta_t is not null").select((F.lit(100.0) * (1 - F.col("delta_t") / F.col("alpha_t"))).alias("h1_saving"), (F.col("delta_s") - F.col("alpha_s")).alias("h2_difference"))
    return kept.select("h1_saving", "h2_difference", F.format_string("%.1f%%", "h1_saving").alias("h1_text"), F.format_string("%+.3f", "h2_difference").alias("h2_text"))


def report(results: DataFrame) -> str:
    """Markdown: a line per baseline, then the two hypotheses where alpha used tokens and delta ran."""
    rows = summary(results).collect()
    out = ["# Evaluation", "", "| baseline | runs | avg input tokens | avg score |", "|---|---|---|---|"]
    out += [f"| {r.baseline} | {r.n} | {r.avg_input_tokens:.0f} | {r.avg_score:.3f} |" for r in rows]
    by = {r.baseline: r for r in rows}
    a, d = by.get("alpha"), by.get("delta")
    if a and d and a.avg_input_tokens > 0:
        out += ["", f"H1 token saving: {100 * (1 - d.avg_input_tokens / a.avg_input_tokens):.1f}%", f"H2 score difference: {d.avg_score - a.avg_score:+.3f}"]
    return "\n".join(out) + "\n"


def write_csv(results: DataFrame, out: str) -> None:
    """Nine columns with a header, score with four decimals; results are tasks times baselines, one file."""
    csv_rows(results).coalesce(1).write.mode("overwrite").csv(out, header=True)


def csv_rows(results: DataFrame) -> DataFrame:
    return results.select(*[F.format_string("%.4f", "score").alias("score") if c.split()[0] == "score" else c.split()[0] for c in RESULT_DDL.split(", ")])


def run(spark: SparkSession, tasks: Iterable[Task], answer: Callable[[Task, str], dict], baselines: Iterable[str] = BASELINES, stale: bool = False) -> DataFrame:
    """Every task under every baseline.  ``answer`` gives output and token counts; where it raises,
    the pair is reported on stderr and left out."""
    rows = []
    for t in tasks:
        for b in baselines:
            began = time.time()
            try:
                a = answer(t, b)
            except Exception as e:  # noqa: BLE001
                print(f"{t.id}/{b}: {e}", file=sys.stderr)
                continue
            rows.append((t.id, b, int(a.get("input_tokens", 0)), int(a.get("output_tokens", 0)), int(a.get("cached_tokens", 0)), int((time.time() - began) * 1000), int(a.get("num_tool_calls", 0)), stale, a.get("output", ""), t.scoring, t.symbols, t.rubric))
    df = spark.createDataFrame(rows, "task_id string, baseline string, input_tokens bigint, output_tokens bigint, cached_tokens bigint, latency_ms bigint, num_tool_calls bigint, stale boolean, output string, scoring string, symbols array<string>, rubric array<string>")
    return score_answers(df).select(*[c.split()[0] for c in RESULT_DDL.split(", ")])
