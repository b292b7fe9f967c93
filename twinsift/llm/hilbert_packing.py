"""Packing along a space-filling curve.

A document's words are hashed into a signed vector of `buckets` counts, which is scaled
to unit length, projected by a fixed random matrix to a few dimensions and turned into
its place on a Hilbert curve.  A histogram of bytes over the curve's cells (65,536 of them)
cuts it into partitions of about equal bytes; a cell that alone has more than one partition's
(thousands of equal texts, say) is dealt to several by a hash of the key column, and of the
place in the input where it is null.  Partitions are sorted by the key and laid out; each partition is cut every
`length` ids, so only its last sequence is padded, and not if its ids are a power of two.

Partitions are as many as have about `partition_bytes` of text each, MOST_PARTITIONS at most.

Defined cases: null or empty text is the end id alone, at the curve's middle; repeated
rows, with an id or without, are separate documents; other columns, whatever their names, are
ignored; an empty table gives no sequences.  A text is held whole while it is tokenised.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import kernels as K
from . import tokens as T

BITS = 10
CELL_BITS = 16  # of the key's: cells of the histogram
MOST_PARTITIONS = 20_000


def hilbert(points, bits=BITS):
    """Hilbert keys of an integer array (rows, dimensions), by the transpose method."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(column, dims=4, buckets=256, seed=7):
    """The Hilbert key of each text of an Arrow string array."""
    turn = np.random.Generator(np.random.PCG64(seed)).standard_normal((buckets, dims))
    out = np.zeros(len(column), dtype=np.int64)
    for a, b in K.slices(column):
        buf, off = K.flat(column.slice(a, b - a))
        h, doc = K.hashed_words(buf, off)
        sign = np.where(h >> np.uint64(63), 1.0, -1.0)
        v = np.bincount(doc * buckets + (h % np.uint64(buckets)).astype(np.int64), weights=sign, minlength=(b - a) * buckets).astype(float).reshape(b - a, buckets)
        v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
        place = np.clip(((v @ turn) / 6 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
        out[a:b] = hilbert(place)
    return out


def cells(lines, partitions):
    """(cells, first partition, number of partitions) in the curve's order, from (cell, bytes):
    each partition gets about the same bytes, a cell stays whole unless it has more than that."""
    lines = sorted(lines)
    cell, size = (np.array([r[i] for r in lines], dtype=np.int64) for i in (0, 1))
    share = max(1.0, float(size.sum()) / partitions)
    end = np.cumsum(size)
    whole = size <= share
    first = np.where(whole, (end - size / 2) / share, np.round((end - size) / share)).astype(np.int64)
    count = np.where(whole, 1, np.maximum(np.round(end / share) - np.round((end - size) / share), 1)).astype(np.int64)
    first = np.minimum(first, partitions - 1)
    return cell, first, np.minimum(count, partitions - first)


def pack(docs, vocabulary=None, length=2048, end_id=1, pad_id=0, text="text", key="doc_id", dims=4, partitions=None, partition_bytes=8 << 20):
    """One row for each sequence (tokens.SEQUENCE), neighbours on the curve side by side."""
    vocabulary = vocabulary or T.default_vocabulary()
    docs = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    place = F.arrow_udf(lambda t: pa.array(curve_keys(t, dims)), "long")
    ordered = docs.withColumn("tie", F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())))
    shift = max(0, dims * BITS - CELL_BITS)
    lines = docs.groupBy(F.shiftright(place("text"), shift).alias("cell")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("bytes")).collect()
    n = partitions or min(MOST_PARTITIONS, -(-max(sum(r["bytes"] for r in lines), 1) // partition_bytes))
    known, first, count = cells([tuple(r) for r in lines], n)

    # key and partition from one function: a second one that takes the first one's result would
    # have a Python worker of its own in each task, and idle workers keep their memory
    def deal(t, tie):
        curve = curve_keys(t, dims)
        at = np.searchsorted(known, curve >> shift)
        return pa.StructArray.from_arrays([pa.array(curve), pa.array((first[at] + tie.to_numpy() % count[at]).astype(np.int32))], ["curve", "part"])

    ordered = ordered.withColumn("dealt", F.arrow_udf(deal, "struct<curve: long, part: int>")("text", "tie")).select("doc_id", "text", "tie", "dealt.*")
    ordered = ordered.repartitionById(n, "part").sortWithinPartitions("curve", "tie", "doc_id").select("doc_id", "text")

    def run(batches):
        encode = T.encoder(vocabulary)
        out = T.Writer((TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, length, pad_id, arrow, bare_powers=True)
        open_, room = [], length
        for batch in batches:
            for doc, t in zip(batch["doc_id"], batch["text"]):
                ids, doc, s = T.document_ids(t.as_py(), encode, end_id), doc.as_py(), 0
                while s < len(ids):
                    take = min(room, len(ids) - s)
                    open_.append((doc, s, ids[s : s + take], len(ids)))
                    s, room = s + take, room - take
                    if not room:
                        out.add(open_)
                        open_, room = [], length
                        if out.full():
                            yield out.take()
        if open_:
            out.add(open_)
        yield out.take()

    return ordered.mapInArrow(run, T.SEQUENCE.format(id=kind.simpleString()))
