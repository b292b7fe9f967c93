"""The corpus pipeline: five stages over documents, each an operator of twinsift.llm.

Rows that share a doc_id, or have none, are separate documents: only texts that a stage
holds to be equal or near make it drop a row.  A stage sees only what its predecessor kept.
All but the last return the columns of documents.
"""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from twinsift.llm import exact_dedup, hilbert_packing, jaccard_join, mixing, quality
from twinsift.llm import kernels as K
from twinsift.llm import tokens as T


def _only(docs, chosen, text_hash):
    """For each (doc_id, text_hash) of `chosen` one row of `docs`: that of the longest text; of
    equal texts the other columns decide."""
    rows = docs.select(F.struct("*").alias("row"), F.struct("doc_id", text_hash.alias("hash")).alias("key"), F.length("text").alias("points"))
    first = Window.partitionBy("key").orderBy(F.desc("points"), F.xxhash64("row"))
    rows = rows.join(chosen.select(F.struct("doc_id", "hash").alias("key")), "key", "left_semi")
    return rows.withColumn("place", F.row_number().over(first)).filter("place = 1").select("row.*")


def quality_classifier(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark, docs, sf_dir):
    """Of equal texts the longest, then first, stays."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")
    return _only(docs, exact_dedup.exact_groups(docs).filter("kept").withColumnRenamed("text_sha256", "hash"), F.sha2(bare, 256))


def near(spark, docs, sf_dir):
    """Of each group of linked texts the document with the least id stays, one without an id
    only where none has one."""
    found = jaccard_join.similar_groups(docs, prints=True)
    least = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("print") == F.col("class_print"))
    return _only(docs, found.filter(least).withColumnRenamed("print", "hash"), F.xxhash64("text"))


def mix(spark, docs, sf_dir):
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def packing(spark, docs, sf_dir):
    """A row for each piece of the packed sequences."""
    return T.pieces_of(hilbert_packing.pack(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact),
    ("ngram_jaccard", near),
    ("source_mixing", mix),
    ("packing", packing),
]

# SQL has neither the classifier nor the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows, read back from the shared folder; the other stages' files go as
    soon as the next stage is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    K.checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs
