"""Incremental scans: a stream of new files keeps a fingerprint table current."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.operators import pairs
from twinsift.operators.components import ensure_checkpoint_dir
from twinsift.sources import cache


def fingerprint_stream(stream: DataFrame, fingerprint, folder, checkpoint, schema="path string, mtime timestamp, size long, hash long", once=True):
    """Starts a query that upserts each batch's fingerprints into the cache at `folder`.

    stream has path, mtime, size and what `fingerprint` (a column) reads.  A batch that is
    run again after a failure gives the same table.
    """
    def upsert(batch, _):
        spark = batch.sparkSession
        ensure_checkpoint_dir(spark)
        new = batch.select("path", "mtime", "size", fingerprint.alias("hash")).dropDuplicates(["path"]).checkpoint()  # read several times
        cache.write_if_changed(spark, folder, cache.read(spark, folder, schema), new)

    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def new_pairs(new: DataFrame, table: DataFrame, threshold, key="path", fp="hash", bits=64) -> DataFrame:
    """Pairs src < dst within the threshold that have a new item.  Only the new items' distinct
    fingerprints send probes; the table's meet them once."""
    both = pairs.settled(new.select(key, fp), key, fp).dropDuplicates([key]).select(F.col(key).alias("i"), F.col(fp).alias("a")).checkpoint()
    all_ = table.join(new.select(key), key, "left_anti").select(key, fp).filter(F.col(fp).isNotNull()).select(F.col(key).alias("j"), F.col(fp).alias("b"))
    all_ = all_.unionByName(both.select(F.col("i").alias("j"), F.col("a").alias("b"))).checkpoint()
    near = pairs.banded_join(both.select(F.col("a").alias("fp")), all_.select(F.col("b").alias("fp")), threshold, bits)
    met = near.join(both, "a").join(all_, "b").filter("i <> j")
    return met.select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), "distance").distinct()
