"""Similarity join on fingerprints: pairs within a Hamming distance.

Equal fingerprints are collapsed first, so copies cost one row in the join.  The distinct ones
meet by keys that any pair within the distance shares, and the exact distance is tested after,
or in cells that test every pair.  `plan` takes what costs least for the number of rows:

* bands with probes: of b parts of the bits at least one differs in threshold // b bits or
  fewer, so one side sends each part and the other all values within that radius (a bit less
  in the last bands, by the remainder);
* combinations: of m > threshold parts at least m - threshold are equal, so both sides send
  the values of every combination of so many parts as one long key;
* cells: fingerprints are packed into blocks, and each pair of blocks is one cell, where NumPy
  tests every pair (about a nanosecond each), so a row is sent once a block and no key at all.

For pairs, up to `few` fingerprints (a checked size) are tested against a broadcast.
"""

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions.scalars import hamming
from twinsift.operators.components import ensure_checkpoint_dir

FEW = 20_000
BLOCK, BLOCKS = 1 << 14, 64  # fingerprints a block; blocks, until a block has to hold more
TILE = 32, 4096  # rows and columns that NumPy tests at once
HELD = 1 << 16  # pairs that a cell holds before it passes them on
MET, TESTED = 1 / 25, 1 / 1000  # what a pair that meets by a key, or in a cell, costs against a row sent


def settled(fps: DataFrame, key, fp) -> DataFrame:
    """Fingerprints computed once; each is read several times below."""
    ensure_checkpoint_dir(fps.sparkSession)
    return fps.filter(F.col(fp).isNotNull()).select(key, fp).checkpoint()


def brute_pairs(fps: DataFrame, threshold, key="id", fp="fp") -> DataFrame:
    """All pairs src < dst within the threshold, by testing each; for at most FEW rows."""
    a = fps.filter(F.col(fp).isNotNull()).select(F.col(key).alias("src"), F.col(fp).alias("a"))
    if a.limit(FEW + 1).count() > FEW:
        raise ValueError(f"more than {FEW} fingerprints; use banded_pairs")
    b = F.broadcast(a.select(F.col("src").alias("dst"), F.col("a").alias("b")))
    return a.join(b, (F.col("src") < F.col("dst")) & (hamming("a", "b") <= threshold)).select("src", "dst", hamming("a", "b").alias("distance"))


def masks(width, radius):
    """All numbers of `width` bits with at most `radius` set."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def parts(bits, n):
    """n runs (first bit, width) that cover the bits."""
    edge = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def plan(n, threshold, bits, most_keys=2048, left=None):
    """(kind, number): the way that costs least for n rows, with themselves or `left` others
    that send the probes, as rows sent and pairs met."""
    m = n if left is None else left
    options = [((n + m) * blocks_of(max(n, m)) + n * m * TESTED / (2 if left is None else 1), "cells", 0)]
    for b in range(1, min(threshold + 1, 16) + 1):
        q, rest = divmod(threshold, b)
        sent = met = 0
        for i, (_, w) in enumerate(parts(bits, b)):
            r = q if i <= rest else q - 1
            probes = sum(comb(w, k) for k in range(r + 1)) if r >= 0 else 0
            sent, met = sent + probes, met + probes / 2**w
        if sent <= most_keys:
            options.append((m * sent + n * b + n * m * met * MET, "bands", b))
    for k in range(threshold + 1, min(threshold + 9, bits) + 1):
        c = k - threshold
        if comb(k, c) <= most_keys:
            sent = comb(k, c)
            options.append(((n + m) * sent + n * m * MET * sent / 2 ** (bits * c // k), "combinations", k))
    return min(options)[1:]


def _longs(values):
    """An array of longs as one literal; one a value would fill the driver with expressions."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _keys(v, threshold, bits, kind, n):
    """(arrays of struct<k, v> that the one side sends, and the other)."""
    def value(a, w):
        return F.shiftrightunsigned(v, a).bitwiseAND(F.lit((1 << w) - 1).cast("long") if w < 64 else F.lit(-1).cast("long"))

    if kind == "bands":
        q, rest = divmod(threshold, n)
        radius = [q if i <= rest else q - 1 for i in range(n)]
        own = F.array(*[F.struct(F.lit(i).alias("k"), value(*p).cast("long").alias("v")) for i, p in enumerate(parts(bits, n)) if radius[i] >= 0])

        def probes(i, p):
            return F.transform(_longs(masks(p[1], radius[i])), lambda m: F.struct(F.lit(i).alias("k"), m.bitwiseXOR(value(*p)).alias("v")))

        return own, F.concat(*[probes(i, p) for i, p in enumerate(parts(bits, n)) if radius[i] >= 0])
    ors = [sum(((1 << w) - 1) << a for a, w in c) for c in combinations(parts(bits, n), n - threshold)]
    picked = F.transform(_longs(m - (1 << 64) if m >> 63 else m for m in ors), lambda m, k: F.struct(k.alias("k"), v.bitwiseAND(m).alias("v")))
    return picked, picked


def blocks_of(n):
    return max(-(-n // BLOCK), 1) if n <= BLOCK * BLOCKS else max(BLOCKS, n >> 20)


def blocks(fps: DataFrame, n) -> DataFrame:
    """Rows b, x: the distinct values of fp, dealt by their hash into n blocks of packed longs."""
    def pack(key, t):
        x = np.concatenate([c.to_numpy() for c in t.column("fp").chunks]).tobytes()
        return pa.table({"b": pa.array([key[0].as_py()], pa.int32()), "x": pa.array([x], pa.binary())})

    dealt = fps.select("fp", F.pmod(F.xxhash64("fp"), F.lit(n)).cast("int").alias("b"))
    return dealt.distinct().groupBy("b").applyInArrow(pack, "b int, x binary").checkpoint()


def places(near):
    """near.nonzero() of a table of few true values: bits are packed, so that bytes without any
    are passed over (nonzero() takes longer than the distances themselves)."""
    packed = np.packbits(near)
    at = packed.nonzero()[0]
    byte, bit = np.unpackbits(packed[at]).reshape(-1, 8).nonzero()
    return np.divmod(at[byte] * 8 + bit, near.shape[1])


def hits(x, y, threshold, same):
    """Arrays (i, j, distance) of positions in x and y within the threshold, tile by tile; i < j
    if both are the same block."""
    x, y = x.view(np.uint64), y.view(np.uint64)
    rows, cols = TILE
    for i in range(0, len(x), rows):
        for j in range(i // cols * cols if same else 0, len(y), cols):
            d = np.bitwise_count(x[i : i + rows, None] ^ y[None, j : j + cols])
            near = d <= threshold
            if near.any():
                a, b = places(near)
                d, a, b = d[a, b], a + i, b + j
                if same:
                    keep = a < b
                    d, a, b = d[keep], a[keep], b[keep]
                yield a, b, d


def held(found):
    """The same arrays, joined up to some HELD pairs."""
    some, n = [], 0
    for h in found:
        some, n = [*some, h], n + len(h[0])
        if n >= HELD:
            yield tuple(map(np.concatenate, zip(*some)))
            some, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*some)))


def forest(found, size, shift):
    """Of arrays i, j, distance, the pairs that link what earlier ones did not, as a forest on
    `size` positions; those of j are counted on from `shift`."""
    up = np.arange(size)
    for a, b, d in found:
        while ((root := up[up]) != up).any():
            up = root
        p, q = up[a], up[b + shift]
        _, first = np.unique(np.minimum(p, q) * size + np.maximum(p, q), return_index=True)
        kept = []
        for k in first[p[first] != q[first]].tolist():
            r, s = int(p[k]), int(q[k])
            while up[r] != r:
                r = int(up[r])
            while up[s] != s:
                s = int(up[s])
            if r != s:
                up[max(r, s)] = min(r, s)
                kept.append(k)
        yield a[kept], b[kept], d[kept]


def cell_join(left: DataFrame, right: DataFrame | None, threshold, links=False) -> DataFrame:
    """Rows a, b, distance of distinct fingerprints a of `left` and b of `right` (columns fp)
    within the threshold, each once; without `right`, pairs a < b of `left`.

    With `links`, of a cell's pairs only those that connect what its others don't, so a large
    group of near fingerprints doesn't send every two of them.
    """
    ensure_checkpoint_dir(left.sparkSession)
    one = right is None
    n = blocks_of(left.count())
    x = blocks(left, n)
    m, y = (n, x) if one else (blocks_of(right.count()), blocks(right, blocks_of(right.count())))
    tasks = min(n * m, 4096)  # a number given: by their bytes, cells would meet in few tasks
    xs = x.select(F.col("b").alias("i"), F.explode(F.sequence(F.col("b") if one else F.lit(0), F.lit(m - 1))).alias("j"), "x").repartition(tasks, "i", "j")
    ys = y.select(F.explode(F.sequence(F.lit(0), F.col("b") if one else F.lit(n - 1))).alias("i"), F.col("b").alias("j"), F.col("x").alias("y")).repartition(tasks, "i", "j")

    def test(batches):
        for t in batches:
            for i, j, x, y in zip(*(t.column(c) for c in ("i", "j", "x", "y"))):
                v, w = (np.frombuffer(c.as_buffer(), np.int64) for c in (x, y))
                same = one and i == j
                found = held(hits(v, w, threshold, same))
                if links:
                    found = forest(found, len(v), 0) if same else forest(found, len(v) + len(w), len(v))
                for a, b, d in found:
                    a, b = v[a], w[b]
                    if one:
                        a, b = np.minimum(a, b), np.maximum(a, b)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d.astype(np.int64))], ["a", "b", "distance"])

    return xs.join(ys.hint("merge"), ["i", "j"]).mapInArrow(test, "a long, b long, distance long")


def banded_join(left: DataFrame, right: DataFrame, threshold, bits=64, keys=None) -> DataFrame:
    """Rows a, b, distance of distinct fingerprints a of `left` and b of `right` (columns fp)
    within the threshold, each once; equal ones too."""
    kind, n = keys or plan(max(right.count(), 1), threshold, bits, left=max(left.count(), 1))
    if kind == "cells":
        return cell_join(left, right, threshold)
    a, b = left.select(F.col("fp").alias("a")).distinct(), right.select(F.col("fp").alias("b")).distinct()
    own, _ = _keys(F.col("b"), threshold, bits, kind, n)
    _, near = _keys(F.col("a"), threshold, bits, kind, n)
    met = a.select("a", F.explode(near).alias("key")).join(b.select("b", F.explode(own).alias("key")), "key")
    return met.filter(hamming("a", "b") <= threshold).select("a", "b", hamming("a", "b").alias("distance")).distinct()


def near_heads(heads: DataFrame, threshold, bits=64, keys=None, links=False) -> DataFrame:
    """Rows a < b, distance of distinct fingerprints (column fp) within the threshold; with
    `links`, at least those that connect them."""
    keys = keys or plan(max(heads.count(), 1), threshold, bits)
    if keys[0] == "cells":
        return cell_join(heads, None, threshold, links)
    return banded_join(heads, heads, threshold, bits, keys).filter("a < b")


def banded_pairs(fps: DataFrame, threshold, key="id", fp="fp", bits=64, keys=None) -> DataFrame:
    """The same pairs as brute_pairs, by equi-joins; copies join by their fingerprint."""
    rows = settled(fps, key, fp).select(F.col(key).alias("i"), F.col(fp).alias("fp"))
    heads = rows.select("fp").distinct().checkpoint()
    near = near_heads(heads, threshold, bits, keys)
    src, dst = rows.select(F.col("i").alias("x"), F.col("fp").alias("a")), rows.select(F.col("i").alias("y"), F.col("fp").alias("b"))
    met = near.join(src, "a").join(dst, "b").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "distance")
    same = src.join(dst, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select(F.col("x").alias("src"), F.col("y").alias("dst"), F.lit(0).cast("long").alias("distance"))
    return met.unionByName(same)


def all_pairs(fps: DataFrame, threshold, key="id", fp="fp", bits=64, few=FEW) -> DataFrame:
    """Pairs by whichever join suits the checked number of fingerprints and the threshold."""
    fps = settled(fps, key, fp)
    small = fps.limit(few + 1).count() <= few
    return brute_pairs(fps, threshold, key, fp) if small else banded_pairs(fps, threshold, key, fp, bits)


def linking_edges(fps: DataFrame, threshold, key="id", fp="fp", bits=64, few=FEW) -> DataFrame:
    """Edges whose components are those of all pairs within the threshold.

    Copies of a fingerprint link to the least key; other links are between those keys.
    """
    some = settled(fps, key, fp)
    heads = some.groupBy(fp).agg(F.min(key).alias("head"))
    copies = some.join(heads, fp).filter(F.col(key) != F.col("head")).select(F.col("head").alias("src"), F.col(key).alias("dst"))
    if threshold == 0:
        return copies
    if threshold >= bits:  # every item is near every other: one star
        least = some.agg(F.min(key).alias("src"))
        return some.crossJoin(F.broadcast(least)).filter(F.col(key) != F.col("src")).select("src", F.col(key).alias("dst"))
    heads = heads.select("head", F.col(fp).alias("fp")).checkpoint()
    near = near_heads(heads.select("fp"), threshold, bits, ("cells", 0) if heads.limit(few + 1).count() <= few else None, links=True)
    a, b = heads.select(F.col("head").alias("src"), F.col("fp").alias("a")), heads.select(F.col("head").alias("dst"), F.col("fp").alias("b"))
    return near.join(a, "a").join(b, "b").select("src", "dst").unionByName(copies)
