"""python -m starlace.cli sort|createdb|dbinfo|run: a thin command line over Graph."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .errors import GraphDataError, PatternError, PlanError
from .operators.match import HINTS, explain
from .plans.pattern import as_pattern
from .sources.graph import LAYOUTS, Graph


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="starlace")
    sub = top.add_subparsers(dest="command", required=True)
    sort = sub.add_parser("sort", help="read an SQLite graph and write it as a graph folder")
    sort.add_argument("sqlite")
    sort.add_argument("path")
    make = sub.add_parser("createdb", help="build a graph folder in a layout")
    make.add_argument("layout", choices=LAYOUTS)
    make.add_argument("--vertices", help="a Parquet table")
    make.add_argument("--edges", help="a Parquet table")
    make.add_argument("--graph", help="or a graph folder")
    make.add_argument("path")
    info = sub.add_parser("dbinfo", help="vertices, edges, vertex labels, edge labels")
    info.add_argument("path")
    run = sub.add_parser("run", help="evaluate a pattern")
    run.add_argument("path")
    query = run.add_mutually_exclusive_group(required=True)
    query.add_argument("query_path", nargs="?")
    query.add_argument("-e", "--execute")
    run.add_argument("--roots", help="such as 1,3")
    run.add_argument("--index-type", choices=[k for k in HINTS if k], default=None)
    run.add_argument("--join-method", choices=["count-rows", "count-rows-slow", "rows", "scan"], default="count-rows", help="scan evaluates the factorized form and keeps nothing")
    run.add_argument("--semantics", choices=["homomorphism", "compat"], default="homomorphism")
    run.add_argument("--output", help="with rows: a Parquet folder")
    run.add_argument("--explain", action="store_true")
    return top


def scan_times(g: Graph, pattern: str, semantics: str, roots: list[int] | None) -> list[tuple[int, int, int]]:
    """Root, its label and milliseconds, of each star made by itself."""
    p = as_pattern(pattern)
    out = []
    for r in roots or decompose(p, g.frequency):
        began = time.time()
        g.star(pattern, r, semantics=semantics).write.format("noop").mode("overwrite").save()
        out.append((r, p.labels[r], round((time.time() - began) * 1000)))
    return out


def _run(spark: SparkSession, a: argparse.Namespace) -> None:
    began = time.time()
    g = Graph.load(spark, a.path)
    if a.execute is None:
        with open(a.query_path) as f:
            a.execute = f.read()
    roots = [int(r) for r in a.roots.split(",")] if a.roots else None
    how = {"semantics": a.semantics, "roots": roots}
    say = lambda text: print(text, file=sys.stderr)
    as_pattern(a.execute)
    if a.explain:
        say(explain(g, a.execute, **how))
    now = time.time()
    if a.join_method == "rows":
        rows = g.match(a.execute, index=a.index_type, **how)
        if a.output:
            rows.write.parquet(a.output)
        else:
            for row in rows.toLocalIterator():
                print(*row)
    elif a.join_method == "scan":
        for root, label, ms in scan_times(g, a.execute, **how):
            say(f"scan_time(u{root}, {label}): {ms}")
        g.match(a.execute, mode="factorized", index=a.index_type, **how).write.format("noop").mode("overwrite").save()
    else:
        mode = "factorized" if a.join_method == "count-rows" else "flat"
        say(f"num_rows: {g.count(a.execute, mode=mode, index=a.index_type, **how).collect()[0][0]}")
    say(f"job_time: {round((time.time() - now) * 1000)}")
    say(f"total_time: {round((time.time() - began) * 1000)}")


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        if a.command == "sort":
            Graph.from_sqlite(spark, a.sqlite).check().save(a.path)
        elif a.command == "createdb":
            g = Graph.load(spark, a.graph) if a.graph else Graph.from_tables(spark.read.parquet(a.vertices), spark.read.parquet(a.edges)).check()
            Graph(g.vertices, g.edges, a.layout).save(a.path)
        elif a.command == "dbinfo":
            print(*Graph.load(spark, a.path).info().collect()[0])
        else:
            _run(spark, a)
    except (PatternError, PlanError, GraphDataError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
