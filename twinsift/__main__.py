"""Command line: scan a directory for near-duplicate images, or compare two."""

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from twinsift import config
from twinsift.functions import images as I
from twinsift.operators.manifest import Mover, auto_failures, auto_summary, move_plan
from twinsift.plans import pipeline, views
from twinsift.sources import files


def session():
    return (
        SparkSession.builder.appName("twinsift").config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    )


def scan(a):
    if not os.path.isdir(a.directory):
        print(f"not a directory: {a.directory}", file=sys.stderr)
        return 1
    cfg = config.ScanConfig(os.path.abspath(a.directory), a.threshold, a.recursive, a.dest and os.path.abspath(a.dest), a.dry_run)
    spark = session()
    groups, members = pipeline.scan_images(spark, cfg, a.cache)
    groups = groups.checkpoint()
    shown = groups.orderBy("group_id").select(views.group_label("group_id", "members", F.lit("pending"), "is_close_call", "suggested_idx"))
    for r in shown.toLocalIterator():
        print(r[0])
    if not a.auto:
        return 0
    there = [(os.path.join(d, n),) for d, _, names in os.walk(cfg.dest_dir) for n in names]
    plan = move_plan(members, groups.select("group_id", F.col("suggested_idx").alias("pick")), cfg, spark.createDataFrame(there, "path string"))
    outcomes = Mover(cfg.dry_run).auto(spark, plan)
    s = auto_summary(outcomes).first()
    print(f"confirmed={s['confirmed']} failed={s['failed']} moved={s['files_moved']} bytes={s['bytes_reclaimed']}")
    for f in auto_failures(outcomes).orderBy("group_id").toLocalIterator():
        print(f"  group {f['group_id'] + 1}: {f['error']} ({f['files_moved']} moved)")
    return int(s["failed"] > 0)


def compare(a):
    spark = session()
    pair = [os.path.abspath(p) for p in (a.a, a.b)]
    there = [files.literal(p) for p in pair if os.path.isfile(p)]
    if len(there) < 2:
        print(f"no such file: {', '.join(p for p in pair if not os.path.isfile(p))}", file=sys.stderr)
        return 1
    rows = spark.read.format("image").load(there).select(files.decoded_uri("image.origin").alias("path"), I.image_metrics().alias("m"))
    read = {r["path"] for r in rows.filter("m is not null").select("path").collect()}
    if missing := [p for p in pair if p not in read]:
        print(f"not a readable image: {', '.join(missing)}", file=sys.stderr)
        return 1
    rows = rows.select("path", "m.*")
    cells = [c for c in views.image_cells() if c[0] not in ("File size", "Quality score (higher better)")]
    for r in views.pairwise_report(rows, "path", *pair, cells).orderBy("row_no").collect():
        print(f"{r['label']:36s} {r['value_a'] or 'n/a':>18s} {r['value_b'] or 'n/a':>18s}")
    return 0


def main(argv=None):
    p = argparse.ArgumentParser("twinsift")
    sub = p.add_subparsers(required=True)
    s = sub.add_parser("scan")
    s.add_argument("directory", nargs="?", default=".")
    s.add_argument("--threshold", type=config.threshold, default=config.DEFAULT_THRESHOLD)
    s.add_argument("--dest")
    s.add_argument("--recursive", "-r", action="store_true")
    s.add_argument("--dry-run", action="store_true")
    s.add_argument("--auto", "--yes", action="store_true")
    s.add_argument("--cache")
    s.set_defaults(run=scan)
    c = sub.add_parser("compare")
    c.add_argument("a")
    c.add_argument("b")
    c.set_defaults(run=compare)
    args = p.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
