"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies each of its documents should
have: a whole part and a fraction.  The fractions are rounded by the pivotal method: two
undecided documents pass words between each other, in a random direction whose chances
keep both expectations, until one of them is whole.  The sum of words stays exact, so a
source ends within one document of its target.

Documents are dealt to buckets (a hot source has many); a bucket is decided in one task
and leaves one undecided document at most, and those are combined by the same step in a
tree of fan-in `fan` until each source has at most one, which is rounded by chance.

Sources are planned on the driver up to `few` of them (a checked number), and beyond that by
the same steps as grouped aggregates.

Defined cases: null text has size 0; a null source is a source of its own, last in order;
a document of size 0 takes no part and takes 0 words; ties and repeated rows are separate
documents, also without an id; other columns, whatever their names, are ignored; an empty table
gives an empty result.  The chances come from a hash of seed, source and bucket, and rows meet
by id and text, so a rerun agrees (rows without an id: on the same files).  A text is read
whole, its words are only counted.
"""

import hashlib
import random

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from twinsift.operators.grouping import number

from . import kernels as K

WEIGHTS = (5, 2, 1)
MOST = 3
FEW_SOURCES = 100_000


def targets(sizes, weights=WEIGHTS, most=MOST):
    """[(source, size)] in order -> targets: shares of the total by weight, none above
    `most` times its source, what is above reshared by weight."""
    total = float(sum(s for _, s in sizes))
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), [i for i, (_, s) in enumerate(sizes)]
    left = total
    while open_:
        all_ = sum(weight[i] for i in open_)
        over = [i for i in open_ if left * weight[i] / all_ > most * sizes[i][1]]
        if not over:
            for i in open_:
                out[i] = left * weight[i] / all_
            break
        for i in over:
            out[i] = float(most * sizes[i][1])
        left -= sum(out[i] for i in over)
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
    return out


def planned(sources, weights, most, few):
    """source, size, rows with source_size, target, for any number of sources."""
    spark = sources.sparkSession
    if sources.limit(few + 1).count() <= few:
        lines = sorted(((r["source"], r["size"], r["rows"]) for r in sources.collect()), key=lambda r: (r[0] is None, r[0] or ""))
        goal = targets([(s, z) for s, z, _ in lines], weights, most)
        columns = [*zip(*((s, z, r, g) for (s, z, r), g in zip(lines, goal)))] or [()] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64()]
        # from Arrow: rows would pass through Python workers, of a daemon of their own
        return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["source", "source_size", "rows", "target"]))
    order = number(sources.withColumn("_o", F.struct(F.col("source").isNull().alias("none"), "source")), "_o", "_n")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_n", F.lit(len(weights))) + 1).cast("int"))
    lines = order.select("source", F.col("size").alias("source_size"), "rows", weight.alias("_w"), F.lit(None).cast("double").alias("target")).checkpoint()
    total = float(lines.agg(F.sum("source_size")).first()[0] or 0)
    most_ = F.lit(float(most)) * F.col("source_size")
    while True:  # what is above its limit is settled, and the rest shared anew
        open_ = F.col("target").isNull()
        taken, all_ = lines.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.sum(F.when(open_, F.col("_w")))).first()
        share = F.lit(total - taken) * F.col("_w") / F.lit(all_ or 1.0)
        over = open_ & (share > most_)
        if lines.filter(over).isEmpty():
            return lines.withColumn("target", F.coalesce("target", share)).drop("_w")
        lines = lines.withColumn("target", F.when(over, most_).otherwise(F.col("target"))).checkpoint()


def pivot(rows, chance):
    """rows: [size, fraction, whole] lists, changed in place; the index left undecided or None.

    Words move between two rows until a fraction is 0 or 1; 1 becomes a whole copy more.
    """
    held = None
    for j, r in enumerate(rows):
        if not 0.0 < r[1] < 1.0:
            continue
        if held is None:
            held = j
            continue
        h = rows[held]
        up = min((1.0 - h[1]) * h[0], r[1] * r[0])  # words the held row can gain
        down = min(h[1] * h[0], (1.0 - r[1]) * r[0])  # words it can give
        move = up if chance.random() * (up + down) < down else -down
        h[1], r[1] = h[1] + move / h[0], r[1] - move / r[0]
        for x in (h, r):
            if x[1] < 1e-9:
                x[1] = 0.0
            elif x[1] > 1.0 - 1e-9:
                x[1], x[2] = 0.0, x[2] + 1
        held = held if h[1] else (j if r[1] else None)
    return held


def _bucket(seed, last):
    """Decides one bucket; on the last level also what would stay undecided."""

    def run(t):
        # large documents first: what stays undecided is then likely a small one
        t = t.take(pc.sort_indices(t, [("size", "descending"), *((c, "ascending") for c in ("doc_id", "print", "row"))]))
        head = t.slice(0, 1).to_pylist()[0]
        chance = random.Random(hashlib.sha256(f"{seed}|{head['source']}|{head['bucket']}|{head['level']}".encode()).digest())
        rows = [[float(s), f, int(w)] for s, f, w in zip(*(t[c].to_pylist() for c in ("size", "fraction", "copies")))]
        left = pivot(rows, chance)
        if left is not None and last:
            rows[left][2] += chance.random() < rows[left][1]
            rows[left][1] = 0.0
        for name, column in (("fraction", pa.array([r[1] for r in rows], pa.float64())), ("copies", pa.array([r[2] for r in rows], pa.int64()))):
            t = t.set_column(t.column_names.index(name), name, column)
        return t

    return run


def mix(docs, weights=WEIGHTS, most=MOST, seed=17, text="text", key="doc_id", source="source", bucket_rows=2_000, fan=64, few=FEW_SOURCES):
    """One row for each row of `docs`: key, source, size, source_size, target, copies, taken,
    and print, the hash of its text, which tells rows of one key apart."""
    K.checkpoint_dir(docs.sparkSession)

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], batch["print"], pa.array(K.word_counts(batch["text"]))], ["doc_id", "source", "print", "size"])

    at = lambda c: F.col(f"`{c}`")
    docs = docs.select(at(key).alias("doc_id"), at(source).cast("string").alias("source"), at(text).cast("string").alias("text")).withColumn("print", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = docs.mapInArrow(count, f"doc_id {kind}, source string, print long, size long").withColumn("row", F.monotonically_increasing_id()).checkpoint()
    plan = planned(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), weights, most, few)
    plan = plan.withColumn("buckets", F.ceil(F.col("rows") / bucket_rows)).drop("rows").checkpoint()
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    deal = F.xxhash64("doc_id", "print", F.when(F.col("doc_id").isNull(), F.col("row")))  # rows without an id don't meet
    all_ = (
        sized.join(plan, sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
        .withColumn("copies", F.floor(rate)).withColumn("fraction", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(F.lit(0.0)))
        .withColumn("bucket", F.pmod(deal, F.col("buckets")).cast("long")).withColumn("level", F.lit(0))
    )
    most_buckets, level, done = plan.agg(F.max("buckets")).first()[0] or 1, 0, None
    while True:
        last = most_buckets == 1
        step = all_.groupBy("source", "bucket").applyInArrow(_bucket(seed, last), all_.schema).checkpoint()
        part = step if last else step.filter("fraction = 0")
        done = part if done is None else done.unionByName(part)
        if last:
            break
        most_buckets, level = -(-most_buckets // fan), level + 1
        all_ = step.filter("fraction > 0").withColumn("bucket", F.floor(F.col("bucket") / fan)).withColumn("level", F.lit(level))
    return done.select(F.col("doc_id").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "print")


def mixed(docs, text="text", key="doc_id", source="source", **options):
    """The mix itself: each row of `docs` as often as the plan has it.

    Rows that share key and text are alike but for other columns; they share the number of
    copies planned for them, the first ones taking what doesn't divide.
    """
    plan = mix(docs, text=text, key=key, source=source, **options)
    plan = plan.groupBy(F.struct(F.col(f"`{key}`").alias("key"), "print").alias("key")).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).filter("copies > 0").checkpoint()
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.struct(docs[f"`{key}`"].alias("key"), F.xxhash64(docs[f"`{text}`"].cast("string")).alias("print")).alias("own"))
    met = rows.join(plan, F.col("own") == F.col("key")).select("row", "key", "copies", "rows")
    one = met.filter("rows = 1").select("row", "copies")
    if not plan.filter("rows > 1").isEmpty():
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row")))
        more = met.filter("rows > 1").withColumn("place", place)
        one = one.unionByName(more.select("row", (F.floor(F.col("copies") / F.col("rows")) + (F.col("place") <= F.col("copies") % F.col("rows")).cast("long")).alias("copies")))
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return one.filter("copies > 0").select("row", copy).select("row.*")
