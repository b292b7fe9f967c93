"""Removal of repeated byte strings by a difference cover, depth `length`.

Every byte that a string of `length` bytes covers is removed if that string also starts
anywhere else.  The sample are the places whose remainder modulo a period lies in a perfect
difference set (12 of each 133 places for 200 bytes): for any two places there is a distance
below the period at which both are sampled, so two equal strings always meet at sampled places
within them.  Only an order up to `length` bytes is needed, so equal names stand in for
neighbours in the sorted order, and each step is one round of `naming`:

1. Sort the sample: a sampled place is named by the `length` - period + 1 bytes after it (68),
   which any equal pair has in common there.  Names that occur once drop out.
2. Recurse on the names that repeat: each becomes a triple of its name, of the names of the
   strings that start in each third of the period before it, and of the whole context that
   all strings through it cover.  A context that occurs twice settles all its strings as
   repeated; a third whose name is alone drops out; one of the places of each context goes on.
3. Merge what remains: strings (sampled or not) that start at the cover's distances before
   such places are named by all their bytes, and equal ones are neighbours.

The runs found are cut out of their block in the same pass that reads the answers.  Names that
only drop candidates have 64 bits; those that settle a removal have 128 (contexts) and 96
(strings), so that no collision is to be expected at any size of corpus.  Work is spread by
ranges of names and blocks of text; a name is one entry a block, so a line that every document
has is no hot key.

Defined cases: null text is empty; texts shorter than `length` keep everything; a string that
repeats inside one document counts; rows that repeat a doc_id, or have none, are separate texts
and each gets its row; other columns, whatever their names, are ignored; an empty table gives
an empty result.  A text of any length is read in steps of a megabyte.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import kernels as K
from . import naming as N

# Perfect difference sets (each difference modulo the period occurs).
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    31: (1, 5, 11, 24, 25, 27),
    133: (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121),
}
THIRDS = 3
SETTLED, GOES_ON = 1, 2  # an entry's answer in the second round; bits 2.. are its thirds


class Cover:
    def __init__(self, length):
        fit = [p for p in COVERS if 3 * p <= 2 * length]
        if not fit:
            raise ValueError(f"strings of {length} bytes are too short to remove; at least {-(-3 * min(COVERS) // 2)}")
        self.length, self.period = length, max(fit)
        self.places = np.array(COVERS[self.period], dtype=np.int64)
        self.name = length - self.period + 1
        edge = np.linspace(0, self.period, THIRDS + 1).astype(int)
        self.thirds = [(int(a), int(b) - 1) for a, b in zip(edge[:-1], edge[1:])]  # distances to a string's start

    def sample(self, off):
        """(place, document) of the sampled places of a block, ascending."""
        starts = np.maximum(np.diff(off) - self.name + 1, 0)
        whole, rest = np.divmod(starts, self.period)
        count = whole * len(self.places) + np.searchsorted(self.places, rest)
        doc = np.repeat(np.arange(len(count)), count)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        return off[doc] + self.period * (k // len(self.places)) + self.places[k % len(self.places)], doc

    def contexts(self, hashed, off, place, doc):
        """(64-bit names of the contexts, 32-bit names of each third; 0: no string there)."""
        a, b = np.maximum(place - self.period + 1, off[doc]), np.minimum(place + self.length, off[doc + 1])
        whole = K.mix(hashed(a, b) ^ K.mix((place - a).astype(np.uint64) * np.uint64(self.length + 1) + (b - place).astype(np.uint64)))
        parts = []
        for lo, hi in self.thirds:
            a, b = place - lo, place + self.length - hi
            fits = (a >= off[doc]) & (b <= off[doc + 1])
            h = np.zeros(len(place), dtype="<u4")
            h[fits] = (hashed(a[fits], b[fits]) >> np.uint64(32)).astype("<u4") | np.uint32(1)
            parts.append(h)
        return whole, parts

    def strings(self, off, place, doc, lo, hi):
        """(first, last) starts of the strings whose distance to a place is from lo to hi."""
        a, b = np.maximum(place - hi, off[doc]), np.minimum(place - lo, off[doc + 1] - self.length)
        return a[a <= b], b[a <= b]


def merged(a, b):
    """Union of closed intervals."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order]) if len(b) else b
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] > b[:-1] + 1
    last = np.append(new[1:], True) if len(a) else new
    return a[new], b[last]


def spread(a, b):
    """All places of disjoint closed intervals."""
    n = b - a + 1
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)


def distinct(one, two):
    """Distinct pairs in sorted order: (index of the first place of each, whether it has more,
    the number of each row)."""
    order = np.argsort(one)
    a, b = one[order], two[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = a[1:] != a[:-1]
    if (~new[1:] & (b[1:] != b[:-1])).any():
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.minimum.reduceat(order, at) if len(at) else order
    return first, np.diff(np.append(at, len(order))) > 1, number


class Block:
    """What a block of texts knows after each round; every pass computes it anew."""

    def __init__(self, cover, number, buf, off):
        self.cover, self.number, self.buf, self.off = cover, number, buf, off
        self.hashed = K.Hasher(buf, cover.length + cover.period)
        self.place, self.doc = cover.sample(off)
        self.name = self.hashed(self.place, self.place + cover.name)

    def first(self):
        names, count = np.unique(self.name, return_counts=True)
        return names, count > 1

    def second(self, alive):
        """Distinct (name, context) pairs of the names that the first round found repeated."""
        at = np.minimum(np.searchsorted(alive, self.name), max(len(alive) - 1, 0))
        on = alive[at] == self.name if len(alive) else np.zeros(len(self.name), bool)
        self.place, self.doc, self.name = self.place[on], self.doc[on], self.name[on]
        whole, parts = self.cover.contexts(self.hashed, self.off, self.place, self.doc)
        self.at, more, self.kind = distinct(self.name, whole)
        return self.name[self.at], whole[self.at], more, *(p[self.at] for p in parts)

    def third(self, told):
        """Sorted names of the strings that are still to be compared; settled intervals."""
        alive, say = N.answers(told, self.number, "<u8", np.uint8)
        self.second(alive)
        settled = say[self.kind] & SETTLED > 0
        cover = self.cover
        self.settled = merged(*cover.strings(self.off, self.place[settled], self.doc[settled], 0, cover.period - 1))
        runs = [(np.zeros(0, np.int64),) * 2]
        for k, (lo, hi) in enumerate(cover.thirds):
            on = self.at[(say & GOES_ON > 0) & (say & (4 << k) > 0)]
            on.sort()
            runs.append(cover.strings(self.off, self.place[on], self.doc[on], lo, hi))
        self.start = spread(*merged(*(np.concatenate(x) for x in zip(*runs))))
        one = self.hashed(self.start, self.start + cover.length)
        two = (self.hashed(self.start, self.start + cover.length, 1) >> np.uint64(32)).astype("<u4")
        at, more, self.string = distinct(one, two)
        return one[at], two[at], more

    def removed(self, told, last):
        """(document, first, end) of the byte runs that go, disjoint and ascending."""
        self.third(told)
        hit = self.start[N.answers(last, self.number, np.uint8)[0][self.string] > 0]
        a, b = merged(np.concatenate([self.settled[0], hit]), np.concatenate([self.settled[1], hit]))
        doc = np.searchsorted(self.off, a, "right") - 1  # a run of starts stays in its document
        split = doc * (self.cover.length + 1)  # and so must the runs of bytes
        a, b = merged(a + split, b + split + self.cover.length - 1)
        doc = np.searchsorted(self.off + np.arange(len(self.off)) * (self.cover.length + 1), a, "right") - 1
        split = doc * (self.cover.length + 1)
        return doc, a - split, b - split + 1


def second_answers(name, whole, more, parts, block):
    """SETTLED, GOES_ON and the thirds that have another place, for each entry of a range."""
    order = np.lexsort((block, whole, name))
    n, w, seen = name[order], whole[order], more[order]
    new = np.ones(len(n), dtype=bool)
    new[1:] = (n[1:] != n[:-1]) | (w[1:] != w[:-1])
    kind = np.cumsum(new) - 1
    many = (np.bincount(kind, weights=1.0 + seen) > 1.5)[kind] if len(n) else np.zeros(0, bool)
    out = np.zeros(len(n), dtype=np.uint8)
    for k, p in enumerate(parts):
        p = p[order]
        alive = N.repeated(K.mix(n ^ K.mix(p.astype(np.uint64) + np.uint64(k << 40))), seen) & (p > 0)
        out |= alive.astype(np.uint8) << np.uint8(2 + k)
    top = np.ones(len(n), dtype=bool)
    top[1:] = n[1:] != n[:-1]
    group = np.cumsum(top) - 1
    # a name goes on if one of its places isn't settled and has a third to be compared
    open_ = np.bincount(group, weights=(~many & (out > 0)).astype(float)) > 0 if len(n) else np.zeros(0, bool)
    out |= np.where(new & open_[group], np.uint8(GOES_ON), np.uint8(0)) if len(n) else out
    out |= many.astype(np.uint8) * np.uint8(SETTLED)
    back = np.empty_like(out)
    back[order] = out
    return back


def repeated_bytes(docs, kind, length):
    """Applies the rounds; rows of each block with what is cut out of its texts."""
    cover = Cover(length)
    spark, size = docs.sparkSession, N.text_bytes(docs)
    packed = N.blocks(docs, kind, size)
    samples = N.ranges_for(spark, size * len(cover.places) // cover.period)
    strings = N.ranges_for(spark, size // 4)

    def first(t):
        return pa.concat_tables(N.ask(n, samples, *Block(cover, n, buf, off).first()) for n, _, buf, off in N.opened(t))

    def second(t, told):
        return pa.concat_tables([N.ask(0, 1, np.zeros(0, np.uint64)), *(N.ask(n, samples, *Block(cover, n, buf, off).second(N.answers(told, n, "<u8")[0])) for n, _, buf, off in N.opened(t))])

    def third(t, told):
        return pa.concat_tables([N.ask(0, 1, np.zeros(0, np.uint64)), *(N.ask(n, strings, *Block(cover, n, buf, off).third(told)) for n, _, buf, off in N.opened(t))])

    def answer_first(t):
        keys, more = N.asked(t, bool)
        again = N.repeated(keys, more)
        return N.answer(t, again, keys)

    def answer_second(t):
        name, whole, more, *parts = N.asked(t, "<u8", bool, *["<u4"] * THIRDS)
        say = second_answers(name, whole, more, parts, np.repeat(t["block"].to_numpy(), t["n"].to_numpy()))
        return N.answer(t, None, name, say)

    def answer_third(t):
        one, two, more = N.asked(t, "<u4", bool)
        return N.answer(t, None, N.repeated(K.mix(one ^ K.mix(two.astype(np.uint64))), more).astype(np.uint8))

    runs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def cut(t, told):
        out, last = [], pc.equal(told["round"], 3)
        for n, ids, buf, off in N.opened(t):
            doc, a, b = Block(cover, n, buf, off).removed(told.filter(pc.invert(last)), told.filter(last))
            edge = np.zeros(len(buf) + 1, dtype=np.int8)
            edge[a] += 1  # runs of one document never touch; of two they may
            edge[b] -= 1
            keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
            left = np.concatenate([[0], np.cumsum(keep)])[off]
            lists = np.searchsorted(doc, np.arange(len(off)))
            kept = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(left.astype("<i4").tobytes()), pa.py_buffer(buf[keep].tobytes())]) if left[-1] < 2**31 else pa.array([buf[x:y][keep[x:y]].tobytes() for x, y in zip(off[:-1], off[1:])], pa.binary())
            pairs = pa.StructArray.from_arrays([pa.array(a - off[doc]), pa.array(b - off[doc])], ["start", "end"])
            out.append(pa.table([ids.cast(id_type), kept, pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pairs).cast(runs), pa.array(np.diff(off))], ["doc_id", "kept", "removed", "n_bytes"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], x) for x in (id_type, pa.binary(), runs, pa.int64())], ["doc_id", "kept", "removed", "n_bytes"])

    by_block = packed.groupBy("block")
    one = N.by_range(by_block.applyInArrow(first, N.ASKED), samples).applyInArrow(answer_first, N.ANSWERED)
    two = N.by_range(by_block.cogroup(one.groupBy("block")).applyInArrow(second, N.ASKED), samples).applyInArrow(answer_second, N.ANSWERED)
    three = N.by_range(by_block.cogroup(two.groupBy("block")).applyInArrow(third, N.ASKED), strings).applyInArrow(answer_third, N.ANSWERED)
    told = two.withColumn("round", F.lit(2)).unionByName(three.withColumn("round", F.lit(3)))
    return by_block.cogroup(told.groupBy("block")).applyInArrow(cut, f"doc_id {kind}, kept binary, removed array<struct<start:long,end:long>>, n_bytes long")


def remove_repeats(docs, length=200, text="text", key="doc_id"):
    """One row for each row of `docs`: key, kept (binary), removed (array of struct<start,end>
    of bytes), n_bytes."""
    docs = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return repeated_bytes(docs, docs.schema["doc_id"].dataType.simpleString(), length).withColumnRenamed("doc_id", key)
