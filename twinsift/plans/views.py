"""What is shown: metric tables, labels, counts and texts, as relations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift import config
from twinsift.functions.scalars import col, direction, fixed, humansize

# Rows of the metrics table as (label, key, kind).
METRIC_ROWS = (
    ("Dimensions", None, "reference"),
    ("File size", None, "reference"),
    ("Sharpness (higher better)", "sharpness_normalized", "metric"),
    ("Eff. res. fraction (higher better)", "effective_resolution_fraction", "metric"),
    ("Eff. res. px equiv (higher better)", "effective_resolution_px_equiv", "metric"),
    ("Noise sigma (lower better)", "noise_sigma", "metric"),
    ("Blockiness (lower better)", "blockiness", "metric"),
    ("BRISQUE (lower better)", "brisque", "metric"),
    ("NIQE (lower better)", "niqe", "metric"),
    ("Quality score (higher better)", None, "score"),
)
# Marks of the states, and below the words of labels and texts.
MARKS = {"pending": "◻", "confirmed": "✔", "skipped": "—"}


def shown(key, digits) -> Column:
    """A metric's text; n/a where it is missing."""
    return F.coalesce(fixed(key, digits), F.lit("n/a"))


def unpivoted(df: DataFrame, keys, cells) -> DataFrame:
    """Rows keys, row_no, label, kind, direction, value for cells (label, kind, weight, text)."""
    each = F.array(*[
        F.struct(F.lit(i).alias("row_no"), F.lit(label).alias("label"), F.lit(kind).alias("kind"), direction(F.lit(kind), F.lit(weight).cast("double")).alias("direction"), text.alias("value"))
        for i, (label, kind, weight, text) in enumerate(cells)
    ])
    return df.select(*keys, F.explode(each).alias("c")).select(*keys, "c.*")


def image_cells():
    """Cells of an analysed image row (metric struct fields, size, quality_score)."""
    out = []
    for label, key, kind in METRIC_ROWS:
        if key:
            weight, digits, _ = config.IMAGE_METRICS[key]
            out.append((label, kind, weight, shown(key, digits)))
        elif kind == "score":
            out.append((label, kind, None, fixed("quality_score", 3)))
        elif label == "Dimensions":
            out.append((label, kind, None, F.format_string("%dx%d", "dimensions.width", "dimensions.height")))
        else:
            out.append((label, kind, None, humansize("size")))
    return out


def best_cells(table: DataFrame, group="group_id", row="label") -> DataFrame:
    """Adds is_best: the cell's number is the best of its row in the group; ties all are.

    Only directed rows with two numbers or more have a best; it is judged on shown values.
    """
    n = F.expr("try_cast(value AS DOUBLE)")
    rows = table.withColumn("_n", n)
    top = rows.groupBy(group, row).agg(F.max("_n").alias("_hi"), F.min("_n").alias("_lo"), F.count("_n").alias("_c"))
    want = F.when(F.col("direction") > 0, F.col("_hi")).otherwise(F.col("_lo"))
    is_best = (F.col("direction") != 0) & (F.col("_c") >= 2) & (F.col("_n") == want)
    return rows.join(top, [group, row]).withColumn("is_best", F.coalesce(is_best, F.lit(False))).drop("_n", "_hi", "_lo", "_c")


def group_label(number, files, status, close, pick) -> Column:
    """Mark, number from 1, files, a warning if close, the pick if confirmed."""
    mark = F.lit(None).cast("string")
    for s, m in MARKS.items():
        mark = F.when(col(status) == s, m).otherwise(mark)
    s = lambda c: (col(c)).cast("string")
    return F.concat(
        mark, F.lit(" Group "), s(col(number) + 1), F.lit(" ("), s(files), F.lit(" files)"), F.when(col(close), " ⚠").otherwise(""),
        F.when(col(status) == "confirmed", F.concat(F.lit(" → ["), s(col(pick) + 1), F.lit("]"))).otherwise(""),
    )


def pending_lines(files, pick, pick_name, suggested, suggested_name):
    """(what confirming would do, where the pick differs from the suggestion)."""
    s = lambda c: (col(c) + 1).cast("string")
    n = col(files) - 1
    act = F.concat(F.lit("keep ["), s(pick), F.lit("] "), col(pick_name), F.when(n > 0, F.concat(F.lit(", move "), n.cast("string"), F.lit(" other file"), F.when(n != 1, "s").otherwise(""))).otherwise(""))
    differs = F.concat(F.lit("your pick ["), s(pick), F.lit("]  ·  ★ suggested ["), s(suggested), F.lit("] "), col(suggested_name))
    return act, F.when(col(pick) != col(suggested), differs).otherwise("")


def pending_text(*columns) -> Column:
    act, differs = pending_lines(*columns)
    return F.concat(act, F.lit("\n"), differs)


def status_text(groups: DataFrame, group="group_id", dry_run=False) -> DataFrame:
    """Per group what is shown while it is looked at: counts of all groups, what confirming
    would do or what was done, and where the pick differs from the suggestion.

    groups: group, status, members, pick, pick_name, suggested, suggested_name, needs_reapply.
    """
    # The words of the status line.
    counts = status_counts(groups)
    n = lambda c: F.col(f"_c.{c}").cast("string")
    head = F.concat(F.lit("Groups: "), n("total"), F.lit("  confirmed="), n("confirmed"), F.lit("  skipped="), n("skipped"), F.lit("  pending="), n("pending"), F.lit("  [DRY RUN]" if dry_run else ""))
    act, differs = pending_lines("members", "pick", "pick_name", "suggested", "suggested_name")
    again = (F.col("status") == "confirmed") & F.col("needs_reapply")
    said = (
        F.when(F.col("status") == "pending", F.concat(act, F.lit("\n"), differs))
        .when(again, F.concat(F.lit("change "), act, F.lit("  (press c/Enter to confirm)\n"), differs))
        .otherwise(F.concat(F.lit("already "), "status", F.lit("\n")))
    )
    one = F.broadcast(counts.select(F.struct("*").alias("_c")))  # a single row
    return groups.join(one).select(group, F.concat(head, F.lit("\n"), said).alias("status_text"))


def status_counts(groups: DataFrame) -> DataFrame:
    c, s = F.count_if(F.col("status") == "confirmed"), F.count_if(F.col("status") == "skipped")
    return groups.agg(F.count("*").alias("total"), c.alias("confirmed"), s.alias("skipped"), (F.count("*") - c - s).alias("pending"))


def metrics_info(spark, metrics) -> DataFrame:
    """Weights by influence: position, name, weight, direction words."""
    order = sorted(metrics, key=lambda k: -abs(metrics[k][0]))
    rows = [(i + 1, k, float(metrics[k][0]), metrics[k][2]) for i, k in enumerate(order)]
    words = F.when(F.col("weight") > 0, "higher better").otherwise("lower better")
    return spark.createDataFrame(rows, "place int, name string, weight double, description string").withColumn("reading", words)


def pairwise_report(df: DataFrame, key, a, b, cells) -> DataFrame:
    """Rows row_no, label, value_a, value_b for two items side by side."""
    t = unpivoted(df.filter(F.col(key).isin(a, b)), [key], cells)
    return t.groupBy("row_no", "label").agg(F.max(F.when(F.col(key) == a, F.col("value"))).alias("value_a"), F.max(F.when(F.col(key) == b, F.col("value"))).alias("value_b"))


def progress_ticks(df: DataFrame, done, total, every=100) -> DataFrame:
    """The counts that are reported: multiples of `every` and the last."""
    return df.filter((F.col(done) % every == 0) | (F.col(done) == F.col(total)))
