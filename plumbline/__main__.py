"""Command line: ``python -m plumbline audit | build-benchmark | export | sample | query``."""

from __future__ import annotations

import argparse
import json

from plumbline import api, session
from plumbline.plans import registry
from plumbline.sinks import files as sinks
from plumbline.sources import package


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("audit", help="annotation files to tables")
    a.add_argument("csv_root")
    a.add_argument("pose_root")
    a.add_argument("images", help="a table of records with their groups and sizes")
    a.add_argument("out")
    b = sub.add_parser("build-benchmark", help="audit tables to entities, consensus and splits")
    b.add_argument("tables")
    b.add_argument("out")
    e = sub.add_parser("export", help="axial crops of the consensus points")
    e.add_argument("tables")
    e.add_argument("out")
    s = sub.add_parser("sample", help="one sample of a package with its points")
    s.add_argument("package")
    s.add_argument("--id")
    q = sub.add_parser("query", help="a registered query")
    q.add_argument("name", choices=sorted(registry.queries()))
    q.add_argument("sf_dir")
    args = p.parse_args(argv)
    spark = session.get_or_create()
    if args.command == "audit":
        tables = api.run_audit(spark, args.csv_root, args.pose_root, spark.read.parquet(args.images))
        for name, df in tables.items():
            sinks.write_both(df, f"{args.out}/{name}")
        sinks.write_document(api.audit_summary(tables), f"{args.out}/summary.json")
    elif args.command == "build-benchmark":
        read = lambda name: spark.read.parquet(f"{args.tables}/{name}.parquet")
        out = api.build_benchmark(read("metadata"), read("keypoints_canonical_long"))
        for name, df in out.items():
            sinks.write_both(df, f"{args.out}/{name}")
        samples = spark.read.parquet(f"{args.out}/benchmark_samples.parquet")
        sinks.write_document(sinks.split_document(samples), f"{args.out}/splits.json")
    elif args.command == "export":
        for name, df in api.export_crops(spark.read.parquet(f"{args.tables}/benchmark_keypoints.parquet")).items():
            sinks.write_both(df, f"{args.out}/{name}")
    elif args.command == "sample":
        root = package.dataset_root(spark, args.package)
        tables = [spark.read.parquet(f"{root}/{package.TABLES[t]}") for t in ("benchmark_samples", "benchmark_keypoints")]
        for row in api.read_sample(*tables, args.id).toJSON().collect():
            print(row)
    else:
        for row in registry.queries()[args.name](spark, args.sf_dir).limit(20).toJSON().collect():
            print(json.dumps(json.loads(row)))


if __name__ == "__main__":
    main()
