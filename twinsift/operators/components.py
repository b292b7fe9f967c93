"""Connected components of an edge list: minimum labels with pointer jumping.

Each round gives a node the least label among its own and its neighbours' (a grouped
minimum, combined on the map side, so a hot node is no hot task) and then follows the
label once more, so paths halve.  Rounds are cut with a checkpoint and the loop ends when
no label changes.
"""

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark):
    """Sets the checkpoint folder that the session names; a local session without one gets a
    temporary folder, a cluster's doesn't, since its executors could not share it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """checkpoint(), without the size that Spark estimated for the rows.

    A checkpoint keeps that estimate, a join's is the product of its sides', and an integer
    of any length holds it: a loop that joins its own results doubles the number's digits
    each round, until the driver does nothing but multiply it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows, session = df.checkpoint()._jdf, df.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(rows.queryExecution().toRdd(), rows.schema(), False), session)


def connected_components(edges: DataFrame, src="src", dst="dst", max_rounds=60) -> DataFrame:
    """Rows node, component (the least node id of the component) for every node of an edge.

    Raises if labels still change after `max_rounds`; nothing is cut short silently.
    """
    one = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b")
    both = cut(one.union(one.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    for _ in range(max_rounds):
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("heard"))
        near = labels.join(heard, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        # the labels of the last round, settled: the members of a large component, who share a
        # label, then meet it in a join of two plain exchanges, which skew handling can split
        far = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))
        step = cut(near.join(far, F.col("label") == F.col("at"), "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        if step.filter("label <> old").isEmpty():
            return step.select("node", F.col("label").alias("component"))
        labels = step.select("node", "label")
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
