"""Group-relative scores, the suggested member and the close-call flag.

Ranges and usability of the metrics are one grouped aggregate (combined on the map side)
joined back, so a group that holds much of the input is no single task.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift import config
from twinsift.functions.scalars import finite


def ranges(df: DataFrame, group, weights) -> DataFrame:
    """Per group and metric: least, greatest, and whether all members have it finite."""
    keys = [group] if isinstance(group, str) else list(group)
    aggs = []
    for m in weights:
        x = F.when(finite(m), F.col(m).cast("double"))
        aggs += [F.min(x).alias(f"{m}_lo"), F.max(x).alias(f"{m}_hi"), F.bool_and(finite(m)).alias(f"{m}_ok")]
    return df.groupBy(*keys).agg(*aggs)


def score(df: DataFrame, group, weights, out="quality_score") -> DataFrame:
    """Weighted mean of the metrics, each scaled to 0..1 in its group, higher better.

    A metric that any member lacks is left out for the group; one that all share gives 0 if
    higher is better and its whole weight if lower is; without a usable metric it is 0.
    """
    keys = [group] if isinstance(group, str) else list(group)
    both = df.join(ranges(df, keys, weights), keys)
    total, weight = F.lit(0.0), F.lit(0.0)
    for m, w in weights.items():
        lo, hi = F.col(f"{m}_lo"), F.col(f"{m}_hi")
        place = F.when(hi == lo, F.lit(0.0)).otherwise((F.col(m).cast("double") - lo) / F.nullif(hi - lo, F.lit(0.0)))
        part = place * w if w > 0 else (1 - place) * abs(w)
        total = total + F.when(F.col(f"{m}_ok"), part).otherwise(F.lit(0.0))
        weight = weight + F.when(F.col(f"{m}_ok"), F.lit(float(abs(w)))).otherwise(F.lit(0.0))
    drop = [f"{m}_{s}" for m in weights for s in ("lo", "hi", "ok")]
    return both.withColumn(out, total / F.when(weight == 0, F.lit(1.0)).otherwise(weight)).drop(*drop)


def suggested(scored: DataFrame, group="group_id", member="member_idx", value="quality_score") -> DataFrame:
    """Per group: members, suggested_idx (best, ties to the first), is_close_call."""
    best = F.max(F.struct(F.col(value).alias("s"), (-F.col(member)).alias("m")))
    g = scored.groupBy(group).agg(F.count("*").cast("int").alias("members"), best.alias("b"))
    rest = scored.join(g.select(group, (-F.col("b.m")).alias("_best")), group).filter(F.col(member) != F.col("_best")).groupBy(group).agg(F.max(value).alias("_second"))
    g = g.join(rest, group, "left")
    return g.select(group, "members", (-F.col("b.m")).cast("int").alias("suggested_idx"), F.coalesce(F.col("b.s") - F.col("_second") < config.CLOSE_CALL_MARGIN, F.lit(False)).alias("is_close_call"))
