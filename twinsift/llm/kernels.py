"""Vectorised text kernels shared by the corpus operators.

Each kernel works on the flat UTF-8 buffer of an Arrow string column, so cost per
document is a few array operations and no Python loop over words.  `slices` keeps
the working set near one megabyte of text (one document at least), which bounds
memory whatever size the Arrow batch has.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from twinsift.operators.components import ensure_checkpoint_dir

# The white space of the contracts: [\x20\x09-\x0D].  All ASCII, so bytes suffice.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WHITE_BYTES = b" \t\n\x0b\x0c\r"

# Two independent polynomial hashes: odd bases and random values of the bytes.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_TABLES = [np.random.Generator(np.random.PCG64(20 + i)).integers(1, 2**63, 256, dtype=np.uint64) for i in range(2)]
_powers = [(np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))] * 2


def checkpoint_dir(spark):
    """Makes checkpoint() usable: the cluster's shared folder if it names one."""
    ensure_checkpoint_dir(spark)
    return spark


def slices(column, limit=1 << 20):
    """(first row, one past the last row) runs of about `limit` bytes of text."""
    buf, off = flat(column)
    n, a = len(off) - 1, 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def parts(batches, column, limit=4 << 20):
    """The batches cut to about `limit` bytes of a text column, to bound what a step holds."""
    for batch in batches:
        for a, b in slices(batch[column], limit):
            yield batch.slice(a, b - a)


def flat(column):
    """A string column as (bytes, offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if large else np.int32
    bufs = column.buffers()
    if len(column) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(bufs[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if bufs[2] is None else np.frombuffer(bufs[2], dtype=np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def powers(n, which=0):
    """base**i and its inverse, modulo 2**64, for i up to n."""
    if len(_powers[which][0]) <= n:
        pair = []
        for b in (_BASES[which], pow(_BASES[which], -1, 2**64)):
            p = np.full(n + 1, b, dtype=np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            pair.append(p)
        _powers[which] = tuple(pair)
    return _powers[which]


def prefix(buf, which=0):
    """Prefix sums of a polynomial hash; range_hash reads any byte range from them."""
    pw, _ = powers(len(buf) + 1, which)
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_TABLES[which][buf] * pw[: len(buf)], out=out[1:])
    return out


def mix(x):
    """The splitmix64 finaliser, in place on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def range_hash(pre, start, end, which=0):
    """64-bit hashes of the byte ranges [start, end); equal bytes, equal hash."""
    _, inv = powers(len(pre), which)
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def hashes(buf, start, end, which=0, step=1 << 20):
    """range_hash of ranges with ascending starts, from prefix sums over about `step` bytes at
    a time, so that a document of any length costs no more memory than that."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        a = int(start[i])
        j = int(np.searchsorted(start, a + step))
        pre = prefix(buf[a : int(end[i:j].max())], which)
        out[i:j] = range_hash(pre, start[i:j] - a, end[i:j] - a, which)
        i = j
    return out


class Hasher:
    """`hashes` of one buffer, whose prefix sums are kept for the next call while the buffer is
    of a block's usual size."""

    STEP, KEEP = 1 << 20, 16 << 20

    def __init__(self, buf, reach):
        """reach: no range is longer."""
        self.buf, self.reach, self.known = buf, reach, {}

    def _prefix(self, k, which):
        if (k, which) in self.known:
            return self.known[k, which]
        pre = prefix(self.buf[k * self.STEP : (k + 1) * self.STEP + self.reach], which)
        if len(self.buf) <= self.KEEP:
            self.known[k, which] = pre
        return pre

    def __call__(self, start, end, which=0):
        out = np.empty(len(start), dtype=np.uint64)
        edge = np.searchsorted(start, np.arange(0, len(self.buf) + self.STEP, self.STEP))
        for k, (i, j) in enumerate(zip(edge[:-1], edge[1:])):
            if j > i:
                out[i:j] = range_hash(self._prefix(k, which), start[i:j] - k * self.STEP, end[i:j] - k * self.STEP, which)
        return out


def words(buf, off):
    """(starts, ends, doc) of the maximal runs of other than white space."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~WHITE[buf]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = ink[:-1]
    edge = off[:-1][off[:-1] < n]
    before[edge] = False
    starts = np.flatnonzero(ink & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = ink[1:]
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(ink & ~after) + 1
    counts = np.diff(np.searchsorted(starts, off))
    return starts, ends, np.repeat(np.arange(len(off) - 1), counts)


def word_counts(column):
    """Number of words of each row."""
    out = np.zeros(len(column), dtype=np.int64)
    for a, b in slices(column):
        buf, off = flat(column.slice(a, b - a))
        out[a:b] = np.bincount(words(buf, off)[2], minlength=b - a)
    return out


def hashed_words(buf, off):
    """(64-bit hash, doc) of each word."""
    s, e, doc = words(buf, off)
    return hashes(buf, s, e), doc


def shingles(buf, off, width=5):
    """(hash, doc) of each run of `width` words; a shorter text has one, of all its words."""
    h, doc = hashed_words(buf, off)
    n = np.bincount(doc, minlength=len(off) - 1)
    acc = np.zeros(len(h), dtype=np.uint64)
    m = len(h)
    for k in range(width):
        acc[: max(m - k, 0)] = mix(acc[: max(m - k, 0)] * np.uint64(3) + h[k:] + np.uint64(k + 1))
    first = np.cumsum(n) - n
    place = np.arange(m) - first[doc]
    whole = place + width <= n[doc]
    # texts of 1 to width - 1 words: the fold above ran into the next text, so fold anew
    for d in np.flatnonzero((n > 0) & (n < width)):
        v = np.zeros(1, dtype=np.uint64)
        for k in range(n[d]):
            v = mix(v * np.uint64(3) + h[first[d] + k : first[d] + k + 1] + np.uint64(k + 1))
        acc[first[d]], whole[first[d]] = v[0], True
    return acc[whole], doc[whole]


def streamed_groups(batches, *keys):
    """Runs of equal whole-number keys in a sorted stream of record batches, as (key, table)."""
    held, now = [], None
    for b in batches:
        cols = [b[k].to_numpy() for k in keys]
        new = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for x, y in zip(edges[:-1], edges[1:]):
            if x == y:
                continue
            key = tuple(int(c[x]) for c in cols)
            if held and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(x, y - x))
    if held:
        yield now, pa.Table.from_batches(held)


def pack_sorted(x):
    """Sorted 64-bit integers as compressed byte planes of their differences."""
    d = np.diff(x, prepend=x.dtype.type(0)).astype("<u8")
    return pack_planes(d.view(np.uint8).reshape(-1, 8))


def unpack_sorted(data, n):
    return np.cumsum(unpack_planes(data, n, 8).view("<u8").ravel(), dtype=np.uint64)


def pack(x):
    """Numbers as compressed byte planes."""
    return pack_planes(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize))


def unpack(data, n, dtype):
    dtype = np.dtype(dtype)
    return unpack_planes(data, n, dtype.itemsize).view(dtype).reshape(-1)


def pack_planes(m):
    """The byte planes of a matrix, each compressed by itself: planes differ in what they hold,
    from noise to zeros, and one code for all of them would fit none."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1, write_content_size=False, write_checksum=False)
    planes = [p.tobytes() for p in np.ascontiguousarray(m.T)]
    out = [min(p, press.compress(p), key=len) for p in planes]
    return np.array([len(p) for p in out], "<u4").tobytes() + b"".join(out)


def unpack_planes(data, n, width):
    import zstandard

    at, planes, open_ = 4 * width, [], zstandard.ZstdDecompressor()
    for size in np.frombuffer(data[:at], "<u4").tolist():
        plane = data[at : at + size]
        planes.append(plane if size == n else open_.decompress(plane, max_output_size=max(n, 1)))
        at += size
    return np.ascontiguousarray(np.frombuffer(b"".join(planes), np.uint8).reshape(width, n).T)
