"""``python -m veldspan.plans.cli job FILE... [--refresh LEVEL]``: run jobs and write their exports.
``python -m veldspan.plans.cli sources FILE DIRECTORY``: load every source of a JSON file ``{name: path}``, report sizes and times, write all exports.
``python -m veldspan.plans.cli landscape TERMS OUT FILE...``: run jobs, write each one's statistics and the table of all, over full term lists.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from veldspan.plans.build import build, export, tabulate
from veldspan.plans.config import Configuration
from veldspan.schema import MAPPING_SETS_SCHEMA
from veldspan.sources.catalog import CATALOG
from veldspan.workspace import write_text


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    job = commands.add_parser("job")
    job.add_argument("files", nargs="+")
    job.add_argument("--refresh", choices=("source", "raw", "processed", "priority"))
    job.add_argument("--no-exports", action="store_true")
    sources = commands.add_parser("sources")
    sources.add_argument("file")
    sources.add_argument("directory")
    land = commands.add_parser("landscape")
    land.add_argument("terms")
    land.add_argument("out")
    land.add_argument("files", nargs="+")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("veldspan").getOrCreate()
    if args.command == "job":
        for path in args.files:
            one = Configuration.from_file(path)
            pack = one.assemble(spark, refresh=args.refresh)
            if not args.no_exports:
                one.write_exports(spark, pack)
    elif args.command == "landscape":
        terms, lines = spark.read.schema("prefix string, id string").parquet(args.terms), []
        for path in args.files:
            one = Configuration.from_file(path)
            lines.append(one.summarize(one.assemble(spark), terms))
        columns = ("name", "total", "reduced", "reduction", "at_least_1", "only_1", "conserved", "raw_mappings", "processed_mappings", "priority_mappings")
        write_text(spark, args.out, "\n".join("\t".join(map(str, row)) for row in [columns, *([x[c] for c in columns] for x in lines)]) + "\n")
    else:
        paths = json.loads(Path(args.file).read_text())
        tasks = [("custom", name, lambda name=name, path=path: CATALOG.get(name)(spark, path)) for name, path in paths.items()]
        rows, summary = build(spark, args.directory, tasks)
        export(rows, args.directory, sets=spark.createDataFrame([], MAPPING_SETS_SCHEMA), set_id="https://example.org/mappings/all.sssom.tsv")
        tabulate(summary).show(1000, truncate=False)


if __name__ == "__main__":
    main()
