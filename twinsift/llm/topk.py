"""Exact top-k search by inner product with pivot-table elimination.

1. A bounded sample gives `pivots` vectors, each the farthest from those before it.  Every
   vector's distances to all pivots are computed once and kept with it (the pivot table), and
   so is its nearest pivot, its cell.
2. For a query q and a candidate c the largest |d(q,p) - d(c,p)| is a lower bound of their
   distance, and so (|q|^2 + |c|^2 - bound^2) / 2 is an upper bound of their inner product.
   The same holds for a whole cell with the least and largest distances of its members.
3. A first pass searches one block of a query's own cell; its k-th best score there is a
   threshold that the final k-th best can't fall below.  The second pass sends a query to the
   blocks of those cells only whose bound reaches the threshold.
4. In a block, candidates are evaluated in the order of their bound until the k-th best score
   is above the next bound; ties of the bound are evaluated too, so the result is exact.

A task has at most about `query_rows` queries and `candidate_rows` candidates; a cell with many
vectors has many blocks.  What comes to the driver is one line a pivot and the sample.

Defined cases: a null vector, or one with a null or non-finite component, takes no part;
missing components of a shorter vector count as 0; equal scores go to the smaller id, and a
null id, which is a candidate but never a query, comes last; equal vectors are separate
candidates; rows that repeat a query's id are queries of their own (query_row tells their
rankings apart) and candidates of each other; fewer than k candidates give all; scores beyond
64 bits count as the limits of a long, and tie there; other columns, whatever their
names, are ignored; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import kernels as K

SCALE = 64
SAMPLE = 2048  # vectors that the pivots are chosen from
LIMIT = 2**63 - 1
ROW = "row long, vec_id long, q binary, d binary, cell int"
RESULT = "query_row long, query_id long, vec_id long, score long, row long"


def quantised(column, scale=SCALE):
    """(row numbers, list of float64 arrays of whole numbers) of the usable vectors."""
    rows, out = [], []
    for i, x in enumerate(column):
        if not x.is_valid or x.values.null_count:
            continue
        v = np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.float64)
        if np.isfinite(v).all():
            rows.append(i)
            with np.errstate(over="ignore"):
                out.append(np.clip(np.floor(scale * v), -1.7e308, 1.7e308))
    return rows, out


def matrix(blobs, width):
    m = np.zeros((len(blobs), width))
    for i, b in enumerate(blobs):
        v = np.frombuffer(b, dtype="<f8")
        m[i, : len(v)] = v
    return m


def floats(blobs):
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)


def farthest(sample, pivots):
    """Rows of the sample, each the farthest from those taken before it."""
    if not len(sample):
        return sample
    taken, away = [0], np.full(len(sample), np.inf)
    while len(taken) < min(pivots, len(sample)):
        away = np.minimum(away, ((sample - sample[taken[-1]]) ** 2).sum(1))
        if away.max() <= 0:
            break
        taken.append(int(away.argmax()))
    return sample[taken]


def distances(m, table):
    """Distances of rows to the pivots; vectors too large to square are infinitely far."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = np.sqrt(np.maximum((m * m).sum(1)[:, None] + (table * table).sum(1) - 2 * m @ table.T, 0))
    return np.where(np.isfinite(d), d, np.inf)


def products(c, q):
    """Exact inner products of whole-number rows with one vector; ends at a long's limits."""
    top = max(1.0, float(np.abs(c).max(initial=0))) * max(1.0, float(np.abs(q).max(initial=0))) * max(len(q), 1)
    if top < 2**53:
        return (c @ q).astype(np.int64)
    if top < 2**63 and max(np.abs(c).max(initial=0), np.abs(q).max(initial=0)) < 2**62:
        return c.astype(np.int64) @ q.astype(np.int64)
    whole = [int(x) for x in q]
    exact = (sum(int(x) * y for x, y in zip(row, whole)) for row in c)
    return np.array([min(max(x, -LIMIT - 1), LIMIT) for x in exact], dtype=np.int64)


def upper(nq, nc, low):
    """Upper bounds of inner products from squared norms and a lower bound of the distance."""
    with np.errstate(invalid="ignore", over="ignore"):
        bound = np.minimum((nq + nc - low * low) / 2, np.sqrt(nq) * np.sqrt(nc))
        bound = bound + 1e-6 * (1 + nq + nc)
    return np.where(np.isnan(bound), np.inf, bound)


def lower(dq, near, far):
    """Lower bounds of the distance to things whose distances to the pivots lie in a range."""
    with np.errstate(invalid="ignore"):
        gap = np.maximum(near - dq, dq - far)
    return np.maximum(np.where(np.isfinite(gap), gap, 0), 0).max(1, initial=0)


def search_block(row, q, dq, least, cid, crow, c, dc, k, chunk=256):
    """Per query (candidate positions, scores) of its k best in a block, and how many
    candidates were evaluated in all.  `least`: scores below it are not wanted."""
    with np.errstate(over="ignore"):
        nq, nc = (q * q).sum(1), (c * c).sum(1)
    found, evaluated = [], 0
    by_pivot, gap = np.ascontiguousarray(dc.T), np.empty(len(c))
    finite = np.isfinite(dc).all() and np.isfinite(dq).all()
    tie = np.where(np.isnan(cid), np.inf, cid)
    for i in range(len(q)):
        if finite:
            low = np.zeros(len(c))
            for p, d in zip(by_pivot, dq[i]):
                np.maximum(low, np.abs(np.subtract(p, d, out=gap), out=gap), out=low)
        else:
            low = lower(dq[i], dc, dc)
        bound = upper(nq[i], nc, low)
        bound[crow == row[i]] = -np.inf
        left = np.flatnonzero(bound >= least[i])
        best, score, size = np.zeros(0, np.int64), np.zeros(0, np.int64), chunk
        while len(left):
            if len(best) == k:
                left = left[bound[left] >= float(score[-1])]
                if not len(left):
                    break
            if len(left) > size:
                part = np.argpartition(-bound[left], size)
                take, left = left[part[:size]], left[part[size:]]
            else:
                take, left = left, left[:0]
            take = take[crow[take] != row[i]]
            evaluated += len(take)
            s, at = np.concatenate([score, products(c[take], q[i])]), np.concatenate([best, take])
            keep = np.lexsort((crow[at], tie[at], ~s))[:k]
            best, score = at[keep], s[keep]
            size *= 4
        found.append((best, score))
    return found, evaluated


def pivot_table(rows, width, pivots):
    """The pivots, from the vectors of a bounded sample (the least hashes)."""
    some = rows.select("q").orderBy(F.xxhash64("q"), "q").limit(SAMPLE).toArrow()
    m = np.unique(matrix(some["q"].to_pylist(), width), axis=0)
    with np.errstate(over="ignore"):
        return farthest(m[np.isfinite((m * m).sum(1))], pivots)


def with_distances(rows, table, width):
    """Rows of ROW: what each vector carries from here on, computed once."""

    def measure(batches):
        for b in batches:
            d = distances(matrix(b["q"].to_pylist(), width), table)
            near = d.argmin(1) if d.shape[1] else np.zeros(len(d), np.int64)
            yield pa.RecordBatch.from_arrays([b["row"], b["vec_id"], b["q"], pa.array([x.astype("<f8").tobytes() for x in d], pa.binary()), pa.array(near.astype(np.int32))], ["row", "vec_id", "q", "d", "cell"])

    return rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(measure, ROW).checkpoint()


def cells(rows, asked, width):
    """One line a cell: its size, its queries, the largest squared norm, least and largest
    distances to each pivot (merged from a line a batch)."""

    def line(cell, n, queries, norm, near, far):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (cell, n, queries, norm)] + [pa.array([x.astype("<f8").tobytes() for x in m], pa.binary()) for m in (near, far)], ["cell", "n", "queries", "norm", "near", "far"])

    def part(batches):
        for b in batches:
            cell, d, m = b["cell"].to_numpy(), floats(b["d"].to_pylist()), matrix(b["q"].to_pylist(), width)
            with np.errstate(over="ignore"):
                norm = (m * m).sum(1)
            asks = b["asks"].to_numpy(zero_copy_only=False)
            of = [cell == x for x in np.unique(cell)]
            yield line(np.unique(cell).astype(np.int32), [int(o.sum()) for o in of], [int(asks[o].sum()) for o in of], [float(norm[o].max()) for o in of], [d[o].min(0) for o in of], [d[o].max(0) for o in of])

    def merge(t):
        near, far = floats(t["near"].to_pylist()), floats(t["far"].to_pylist())
        return pa.Table.from_batches([line(t["cell"].to_numpy()[:1], [sum(t["n"].to_pylist())], [sum(t["queries"].to_pylist())], [max(t["norm"].to_pylist())], [near.min(0)], [far.max(0)])])

    kind = "cell int, n long, queries long, norm double, near binary, far binary"
    marked = rows.withColumn("asks", F.coalesce(asked, F.lit(False)))
    return sorted(marked.mapInArrow(part, kind).groupBy("cell").applyInArrow(merge, kind).collect(), key=lambda r: r["cell"])


def searched(cand, queries, width, k):
    """Both sides are dealt to (block, chunk); a group is one task's search."""

    def search(c, q):
        if not c.num_rows or not q.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_row", "query_id", "vec_id", "score", "row")})
        ids = c["vec_id"].to_pylist()  # ties go by their order, which doubles hold exactly
        known = sorted({x for x in ids if x is not None})
        place = {x: i for i, x in enumerate(known)}
        cid = np.array([np.nan if x is None else place[x] for x in ids])
        crow, row = c["row"].to_numpy(), q["of_row"].to_numpy()
        found, _ = search_block(row, matrix(q["of_q"].to_pylist(), width), floats(q["of_d"].to_pylist()), q["of_least"].to_numpy(), cid, crow, matrix(c["q"].to_pylist(), width), floats(c["d"].to_pylist()), k)
        n = [len(b) for b, _ in found]
        at = np.concatenate([b for b, _ in found])
        back = pa.array(np.repeat(np.arange(len(n)), n))
        return pa.table([q["of_row"].take(back), q["of_vec_id"].take(back), c["vec_id"].take(pa.array(at)), pa.array(np.concatenate([s for _, s in found]), pa.int64()), pa.array(crow[at])], ["query_row", "query_id", "vec_id", "score", "row"])

    queries = queries.select(*[F.col(c).alias(f"of_{c}") for c in queries.columns])  # both sides come from the same rows
    return cand.groupBy("block", "chunk").cogroup(queries.groupBy("of_block", "of_chunk")).applyInArrow(search, RESULT)


def topk(vectors, is_query, k=20, pivots=64, key="vec_id", vector="embedding", scale=SCALE, candidate_rows=8192, query_rows=4096):
    """Rows query_row, query_id, rank, vec_id, score.  is_query: a condition on the key column
    that states which rows are queries."""
    spark = K.checkpoint_dir(vectors.sparkSession)
    source = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v"))

    def quantise(batches):
        for b in batches:
            rows, out = quantised(b["v"], scale)
            yield pa.RecordBatch.from_arrays([b["vec_id"].take(pa.array(rows, pa.int64())), pa.array([x.astype("<f8").tobytes() for x in out], pa.binary()), pa.array([len(x) for x in out], pa.int32())], ["vec_id", "q", "width"])

    plain = source.mapInArrow(quantise, "vec_id long, q binary, width int")
    n, width = plain.agg(F.count("*"), F.max("width")).first()
    if not n:
        return spark.createDataFrame([], "query_row long, query_id long, rank int, vec_id long, score long")
    rows = with_distances(plain, pivot_table(plain, width, pivots), width)
    asked = is_query(F.col("vec_id"))
    lines = cells(rows, asked, width)
    size = {r["cell"]: r["n"] for r in lines}
    parts = {c: -(-m // candidate_rows) for c, m in size.items()}
    number = {c: i for i, c in enumerate(size)}
    first = np.cumsum([0, *(parts[c] for c in size)]).tolist()  # blocks before each cell
    near, far = floats([r["near"] for r in lines]), floats([r["far"] for r in lines])
    norm = np.array([r["norm"] for r in lines])

    def by_cell(of, values):
        return F.element_at(F.create_map(*[x for c, v in values.items() for x in (F.lit(c), F.lit(int(v)).cast("long"))]), of)

    def dealt(chunks):
        """Candidates in blocks, once for each chunk of queries that meets their cell."""
        block = by_cell(F.col("cell"), {c: first[number[c]] for c in size}) + F.pmod(F.xxhash64("row"), by_cell(F.col("cell"), parts))
        each = F.explode(F.sequence(F.lit(0).cast("long"), by_cell(F.col("cell"), chunks) - 1))
        return rows.filter(F.col("cell").isin(*[c for c, m in chunks.items() if m])).select("row", "vec_id", "q", "d", block.alias("block"), each.alias("chunk"))

    mine = rows.filter(asked)
    # first pass: one block of the query's own cell
    once = {r["cell"]: -(-r["queries"] // (query_rows * parts[r["cell"]])) for r in lines}
    own = by_cell(F.col("cell"), {c: first[number[c]] for c in size}) + F.pmod(F.xxhash64("row", F.lit(1)), by_cell(F.col("cell"), parts))
    chunk = F.pmod(F.xxhash64("row", F.lit(2)), F.greatest(by_cell(F.col("cell"), once), F.lit(1)))
    start = mine.select("row", "vec_id", "q", "d", F.lit(float("-inf")).alias("least"), own.alias("block"), chunk.alias("chunk"))
    seen = searched(dealt(once), start, width, k).groupBy("query_row").agg(F.count("*").alias("c"), F.min("score").alias("s"))
    least = F.when(F.col("c") >= k, F.col("s").cast("double")).otherwise(F.lit(float("-inf")))
    told = mine.join(seen, F.col("row") == F.col("query_row"), "left").select("row", "vec_id", "q", "d", F.coalesce(least, F.lit(float("-inf"))).alias("least"))

    def reached(batches):
        names = np.array(list(size), dtype=np.int32)
        for b in batches:
            d, m = floats(b["d"].to_pylist()), matrix(b["q"].to_pylist(), width)
            with np.errstate(over="ignore"):
                nq = (m * m).sum(1)
            open_ = [names[upper(nq[i], norm, lower(d[i], near, far)) >= t] for i, t in enumerate(b["least"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("row", "vec_id", "q", "d", "least")), pa.array(open_, pa.list_(pa.int32()))], ["row", "vec_id", "q", "d", "least", "cells"])

    open_ = told.mapInArrow(reached, "row long, vec_id long, q binary, d binary, least double, cells array<int>").checkpoint()
    met = {r["cell"]: r["count"] for r in open_.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()}
    twice = {c: -(-met.get(c, 0) // query_rows) for c in size}
    asks = open_.withColumn("cell", F.explode("cells")).withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(3)), F.greatest(by_cell(F.col("cell"), twice), F.lit(1))))
    base = by_cell(F.col("cell"), {c: first[number[c]] for c in size})
    asks = asks.select("row", "vec_id", "q", "d", "least", F.explode(F.sequence(base, base + by_cell(F.col("cell"), parts) - 1)).alias("block"), "chunk")
    order = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    best = searched(dealt(twice), asks, width, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_row", "query_id", "rank", "vec_id", "score")
