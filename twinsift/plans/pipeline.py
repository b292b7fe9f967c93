"""The engine's lifecycle: items -> fingerprints -> edges -> groups -> scores -> picks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift import config
from twinsift.functions import images as I
from twinsift.operators import grouping, pairs, scoring
from twinsift.operators.components import ensure_checkpoint_dir
from twinsift.sources import cache, files

HASHES = "path string, mtime timestamp, size long, hash long"
RESULTS = f"path string, mtime timestamp, size long, result {I.METRIC_TYPE}"


def build_groups(items: DataFrame, fps: DataFrame, metrics: DataFrame, weights, threshold, key="id", order=None, bits=64):
    """(groups, scored members) of near-duplicate items.

    items: key and columns to keep; fps: key, fp; metrics: key and metric columns, asked for
    grouped items only, so a costly metric runs on those.  Groups are group_id, members,
    suggested_idx, is_close_call.
    """
    edges = pairs.linking_edges(fps, threshold, key, "fp", bits)
    grouped = grouping.members(items, edges, key, order)
    kept = grouping.surviving(grouped, metrics.join(grouped.select(key), key, "left_semi"), key)
    scored = scoring.score(grouping.renumbered(kept), "group_id", weights)
    return scoring.suggested(scored), scored


def scan_images(spark, cfg: config.ScanConfig, cache_dir=None):
    """(groups, scored members) of the images in a directory.

    With cache_dir, hashes and metrics of unchanged files (path, time, size) are read back, and
    only what is new is read and decoded; failed images stay out of the analysis cache.
    """
    found = files.scan(spark, cfg).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))

    def computed(rows, value, compute):
        return files.images(spark, cfg, rows).select("path", compute().alias(value)).join(rows, "path").select("path", "mtime", "size", value)

    def cached(name, schema, value, rows, compute):
        if cache_dir is None:
            return computed(rows, value, compute).checkpoint()
        folder = f"{cache_dir}/{name}"
        old = cache.read(spark, folder, schema)
        new = computed(cache.misses(rows, old, value), value, compute)
        new = (new if value == "hash" else new.filter(F.col(value).isNotNull())).checkpoint()
        got = cache.lookup(rows, old, value).filter("is_hit").drop("is_hit").checkpoint()
        cache.write_if_changed(spark, folder, old, new)
        return got.unionByName(new)

    ensure_checkpoint_dir(spark)
    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(most, str(2**31 - 1))) > I.BATCH_BYTES:
        spark.conf.set(most, str(I.BATCH_BYTES))
    found = found.checkpoint()
    hashes = cached("hashes", HASHES, "hash", found, I.image_hash)
    edges = pairs.linking_edges(hashes.select("path", F.col("hash").alias("fp")), cfg.threshold, "path")
    grouped = grouping.members(found, edges, "path", files.path_key("path")).checkpoint()
    results = cached("results", RESULTS, "result", grouped.select("path", "mtime", "size"), I.image_metrics)
    metrics = results.filter("result is not null").select("path", "result.*")
    kept = grouping.surviving(grouped, metrics, "path")
    scored = scoring.score(grouping.renumbered(kept), "group_id", config.IMAGE_WEIGHTS)
    return scoring.suggested(scored), scored
