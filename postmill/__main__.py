"""Reports over a folder of tables as key=value lines. Exit status: 0 sound, 1 something that must be 0 isn't, 2 the run failed."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="postmill", description=__doc__)
    parser.add_argument("mode", choices=("inventory", "structure", "gates", "envelope", "dry-run", "export"))
    parser.add_argument("tables", help="folder of the Parquet tables")
    parser.add_argument("--to", help="where an export goes")
    parser.add_argument("--consent", action="store_true", help="replace files of an earlier export that differ")
    args = parser.parse_args(argv)
    if (args.mode == "export") != bool(args.to) or args.consent and not args.to:
        parser.error("--to goes with export, and --consent with --to")
    from postmill import queries
    from postmill.operators.sink import Refused
    from postmill.sources.scratch import release

    spark = SparkSession.builder.appName("postmill").getOrCreate()
    try:
        if args.mode == "export":
            for k, v in queries.write_archive(spark, args.tables, args.to, args.consent).items():
                print(f"{k}={v}")
            return 0
        if args.mode == "dry-run":
            found = queries.dry_run_report(spark, args.tables)
        else:
            found = queries.QUERIES[{"inventory": "message_census", "structure": "structural_gates", "gates": "container_gates", "envelope": "envelope_report"}[args.mode]](spark, args.tables)
        rows = found.orderBy("ord").collect()
    except Refused as e:  # the label tells nothing of any content
        print(f"refused={e}", file=sys.stderr)
        return 1
    except Exception as e:  # an error's text may hold content or paths: only its kind is told
        print(f"error={type(e).__name__}", file=sys.stderr)
        return 2
    finally:
        release(spark)
    for r in rows:
        print(f"{r.key}={r.value}")
    bad = ("collisions", "over_budget", "invalid_names", "unit_mismatches")
    return int(any(r.value for r in rows if r.key in bad) or any(not r.holds for r in rows if "holds" in r))


if __name__ == "__main__":
    sys.exit(main())
