"""Exact deduplication by content-defined chunk recipes.

1. Every text loses its white space and is cut where a rolling hash of the last 32
   bytes has its low bits zero, so equal texts are cut alike.  A text becomes a recipe:
   the ordered list of its chunks' 128-bit fingerprints.
2. Each chunk travels once: distinct (fingerprint, bytes) pairs, combined on the map
   side, show whether a fingerprint stands for one byte string.  One that stands for
   more is replaced in the recipes by the SHA-256 of the chunk.
3. Texts are equal when their lists of verified identifiers are; only those lists and
   one line a document are grouped, so long texts never move again.

Defined cases: null text is empty, all empty texts form one group; equal code point
counts go to the smaller doc_id (of any type that has an order), and a null one last; rows
that repeat a doc_id each get a row, and exactly one row of a group is kept, of equal ones the
one of the least text hash, then the first read; other columns, whatever their names, are
ignored; an empty table gives an empty result.  A text is held whole, with two copies of its
normalised bytes and hashes of a megabyte at a time.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F

from . import kernels as K

WINDOW = 32


def cuts(buf, off, average, most):
    """For each document the ends of its chunks, relative to its start."""
    bits = max(1, int(average).bit_length() - 1)
    out = []
    if len(buf) > WINDOW:
        step, found = 1 << 20, []
        for a in range(WINDOW, len(buf) + 1, step):
            at = np.arange(a, min(a + step, len(buf) + 1))
            h = K.hashes(buf, at - WINDOW, at)
            found.append(at[(h & np.uint64((1 << bits) - 1)) == 0])
        ends = np.concatenate(found)
    else:
        ends = np.zeros(0, np.int64)
    lo = np.searchsorted(ends, off[:-1] + WINDOW, "left")
    hi = np.searchsorted(ends, off[1:], "left")
    for d in range(len(off) - 1):
        n, last, mine = int(off[d + 1] - off[d]), 0, []
        for e in (*(ends[lo[d] : hi[d]] - off[d]).tolist(), n):
            while e - last > most:  # at most `most` bytes, counted from the last cut
                last += most
                mine.append(last)
            if e > last:
                mine.append(e)
                last = e
        out.append(mine)
    return out


def _chunks(column, average, most):
    """(row, normalised bytes, chunk ends) of each text."""
    for a, b in K.slices(column):
        norm = [(x.as_buffer().to_pybytes() if x.is_valid else b"").translate(None, K.WHITE_BYTES) for x in column.slice(a, b - a)]
        off = np.concatenate([[0], np.cumsum([len(x) for x in norm])]).astype(np.int64)
        buf = np.frombuffer(b"".join(norm), dtype=np.uint8)
        for i, (text, ends) in enumerate(zip(norm, cuts(buf, off, average, most))):
            yield a + i, text, ends


def _split(text, ends):
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def fingerprint(chunk):
    return xxhash.xxh3_128_digest(chunk)


def exact_groups(docs, text="text", key="doc_id", average=2048, most=16384, name=fingerprint):
    """One row for each row of `docs`: key, keep_id, group_size, kept, text_sha256, n_chunks.
    `name` gives a chunk's fingerprint."""
    K.checkpoint_dir(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def recipes(batches):
        for batch in K.parts(batches, "text"):
            points = pc.fill_null(pc.utf8_length(batch["text"]), 0)
            rows = [(hashlib.sha256(t).hexdigest(), [name(c) for c in _split(t, e)]) for _, t, e in _chunks(batch["text"], average, most)]
            prints = [xxhash.xxh3_64_intdigest(t.as_buffer() if t.is_valid else b"") - 2**63 for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pc.cast(points, pa.int64()), pa.array(prints, pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.binary()))],
                ["doc_id", "points", "print", "text_sha256", "recipe"],
            )

    def contents(batches):
        for batch in K.parts(batches, "text"):
            seen = {}
            for _, t, e in _chunks(batch["text"], average, most):
                for c in _split(t, e):
                    seen[c] = None
            yield pa.RecordBatch.from_arrays([pa.array([name(c) for c in seen], pa.binary()), pa.array(list(seen), pa.binary())], ["fp", "bytes"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    lines = docs.mapInArrow(recipes, f"doc_id {id_type}, points long, print long, text_sha256 string, recipe array<binary>")
    lines = lines.withColumn("row", F.monotonically_increasing_id()).checkpoint()  # short lines; read again below
    clash = docs.select("text").mapInArrow(contents, "fp binary, bytes binary").distinct().groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp")
    lines = verified(lines, docs, clash, average, most)
    # a row for each group from map-side combined minima, then back to the members
    first = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("none"), "doc_id", "print", "row")).alias("first")
    best = lines.groupBy("recipe").agg(first, F.count("*").alias("group_size")).filter("group_size > 1")
    best = best.select("recipe", F.col("first.doc_id").alias("kept_id"), F.col("first.row").alias("kept_row"), "group_size").checkpoint()
    lines = lines.join(best, "recipe", "left")
    alone = F.col("group_size").isNull()
    return lines.select(
        F.col("doc_id").alias(key), F.when(alone, F.col("doc_id")).otherwise(F.col("kept_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("kept_row"))).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"),
    )


def verified(lines, docs, clash, average, most):
    """Recipes whose identifiers stand for one byte string each.

    Fingerprints in `clash` have more than one content; in a recipe that has one of them
    every identifier becomes the SHA-256 of the text's chunk at that place.  Recipes depend on
    the normalised text alone, so they are found again by its hash.
    """
    clash = clash.checkpoint()
    if clash.isEmpty():
        return lines

    def long_names(batches):
        for batch in K.parts(batches, "text"):
            rows = [(hashlib.sha256(t).hexdigest(), [hashlib.sha256(c).digest() for c in _split(t, e)]) for _, t, e in _chunks(batch["text"], average, most)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.binary()))], ["hash", "strong"])

    hit = lines.select(F.col("text_sha256").alias("hash"), F.explode("recipe").alias("fp")).join(clash, "fp", "left_semi").select("hash").distinct()
    strong = docs.select("text").mapInArrow(long_names, "hash string, strong array<binary>").dropDuplicates(["hash"]).join(hit, "hash", "left_semi").checkpoint()
    return lines.join(strong, lines["text_sha256"] == strong["hash"], "left").withColumn("recipe", F.coalesce("strong", "recipe")).drop("hash", "strong")
