"""python -m plumbline list | query NAME TABLES [--out DIR] | report CONFIG TABLES OUT | plan TABLES"""

from __future__ import annotations

import argparse
import sys

from plumbline import config, report
from plumbline.operators import planning
from plumbline.plans import registry
from plumbline.session import session, ship


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list")
    q = verbs.add_parser("query")
    q.add_argument("name")
    q.add_argument("tables")
    q.add_argument("--out")
    r = verbs.add_parser("report")
    r.add_argument("config")
    r.add_argument("tables")
    r.add_argument("out")
    t = verbs.add_parser("plan")
    t.add_argument("tables")
    p.add_argument("--master", default=None)
    args = p.parse_args(argv)
    if args.verb == "list":
        print("\n".join(sorted(registry.queries())))
        return 0
    try:
        settings = config.load(args.config) if args.verb == "report" else None
    except (OSError, ValueError) as e:
        print(f"config: {e}", file=sys.stderr)
        return 1
    if args.verb == "query" and args.name not in registry.queries():
        print(f"no query {args.name}", file=sys.stderr)
        return 1
    spark = ship(session(args.master))
    read = lambda name: spark.read.parquet(f"{args.tables}/{name}.parquet")
    if args.verb == "query":
        df = registry.queries()[args.name](spark, args.tables)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(50, truncate=60)
    elif args.verb == "plan":
        planning.missing(planning.tasks(read("run_manifests")), read("answers")).groupBy("run_id", "engine").count().show(1000)
    else:
        built, table = report.build(settings, read("answers"), read("citations"), read("fetched_pages"))
        report.write(built, table, args.out)
        return 0 if not built["warnings"] else 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
