"""Command line: index, headers, pixels, summarize, coverage, duplicates, manifest, split, sweep."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from . import stages
from .sources.tables import write_report
from .sweep import write_sweep


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="radiolith", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *arguments: tuple) -> None:
        p = verbs.add_parser(name)
        for flag, options in arguments:
            p.add_argument(flag, **options)

    audit, shards, force = ("--audit-root", {"required": True}), ("--shards", {"default": "all"}), ("--force", {"action": "store_true"})
    series, labels = ("--series-csv", {}), ("--labels-csv", {})
    verb("index", ("--dicom-root", {"required": True}), audit, ("--num-shards", {"type": int, "default": 128}), ("--include-hidden", {"action": "store_true"}), force)
    verb("headers", audit, ("--salt-file", {"required": True}), shards, force)
    verb("pixels", audit, ("--deep-rate", {"type": float, "default": 0.01}), shards, force)
    verb("summarize", audit, series, labels, ("--report", {}))
    verb("coverage", audit, ("--labels-csv", {"required": True}))
    verb("duplicates", audit)
    verb("manifest", audit, ("--out", {"required": True}), series, labels, ("--max-windows", {"type": int, "default": 0}))
    verb("split", ("--manifest", {"required": True}), ("--out", {"required": True}), ("--folds", {"type": int, "default": 5}), ("--seed", {"type": int, "default": 2026}), ("--edges-csv", {}))
    verb("sweep", ("--config", {"nargs": "+", "required": True}), ("--matrix", {"required": True}), ("--out", {"required": True}))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.verb == "sweep":
        from .config import load_config

        print("\n".join(write_sweep(a.config, load_config([a.matrix]), a.out)))
        return 0
    spark = spark or SparkSession.builder.appName(f"radiolith-{a.verb}").getOrCreate()
    if a.verb == "summarize":
        summary = stages.summarize(spark, a.audit_root, a.series_csv, a.labels_csv)
        write_report(summary, a.report) if a.report else print(json.dumps(summary, indent=1, default=str))
        return 0
    run = {
        "index": lambda: stages.index(spark, a.dicom_root, a.audit_root, a.num_shards, a.include_hidden, a.force),
        "headers": lambda: stages.headers(spark, a.audit_root, a.salt_file, a.shards, a.force),
        "pixels": lambda: stages.pixels(spark, a.audit_root, a.deep_rate, a.shards, a.force),
        "coverage": lambda: stages.coverage(spark, a.audit_root, a.labels_csv),
        "duplicates": lambda: stages.find_duplicates(spark, a.audit_root),
        "manifest": lambda: stages.build_manifest(spark, a.audit_root, a.out, a.series_csv, a.labels_csv, a.max_windows),
        "split": lambda: stages.split_folds(spark, a.manifest, a.out, a.folds, a.seed, a.edges_csv),
    }[a.verb]
    for row in run().toLocalIterator():
        print(json.dumps(row.asDict(), default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
