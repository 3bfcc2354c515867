"""Command line: list the registered queries or run one and write its result.

    python -m retentia list
    python -m retentia run <query> --data <folder of input tables> --out <output folder> [--format parquet]
    python -m retentia show <query> --data <folder> [-n 20]

Under ``spark-submit`` the session comes from the submit configuration; run directly,
a local session is started (UI off).  Results are written by the executors (a folder
of part files); nothing is collected except the rows ``show`` prints.
"""

from __future__ import annotations

import argparse
import os
import sys


def _session():
    from pyspark.sql import SparkSession

    if os.environ.get("SPARK_ENV_LOADED") or SparkSession.getActiveSession() is not None:
        return SparkSession.builder.getOrCreate()
    from retentia.session import local_session

    return local_session()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="python -m retentia")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    r = sub.add_parser("run")
    r.add_argument("query")
    r.add_argument("--data", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--format", default="parquet")
    s = sub.add_parser("show")
    s.add_argument("query")
    s.add_argument("--data", required=True)
    s.add_argument("-n", type=int, default=20)
    a = p.parse_args(argv)

    from retentia.plans import catalog

    from retentia.plans.registry import EXITS

    reg = {**catalog.load(), **EXITS}
    if a.cmd == "list":
        for name, e in reg.items():
            print(f"{name:32s} {e.op_ids:24s} {'exit' if name in EXITS else 'sql' if e.sql else 'rows'}")
        return 0
    if a.query not in reg:
        print(f"unknown query {a.query}", file=sys.stderr)
        return 2
    spark = _session()
    df = reg[a.query].build(spark, a.data)
    if a.cmd == "run":
        df.write.mode("overwrite").format(a.format).save(a.out)
        print(a.out)
    else:
        df.show(a.n, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
