"""Binary token output by best-fit-decreasing packing.

Every document becomes token ids and an end id.  Documents longer than a sequence are
split without loss: whole sequences first, then the remainder.  Remainders are packed
best-fit-decreasing, where a segment tree over the free capacities finds the fullest
sequence that still has room.  A task packs the documents of its own partition in pools
of a bounded number of ids, so there is no shuffle, memory doesn't grow with the input,
and a lost task is done again with the same result.

Defined cases: null or empty text is the end id alone; equal lengths go in the order
read; repeated rows, with an id or without, are separate documents; other columns, whatever
their names, are ignored; an empty table gives no sequences.  A text is held whole while it is
tokenised.
"""

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import kernels as K
from . import tokens as T


class Capacities:
    """A segment tree over capacities 0..size-1 that holds the open bins of each."""

    def __init__(self, size):
        self.leaves = 1 << (size - 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins = {}

    def put(self, capacity, bin_):
        self.bins.setdefault(capacity, []).append(bin_)
        self._change(capacity, 1)

    def _change(self, capacity, by):
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def pull(self, least):
        """Takes out a bin of the smallest capacity >= least; (capacity, bin) or None."""
        i = least + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        bin_ = self.bins[capacity].pop()
        self._change(capacity, -1)
        return capacity, bin_


def best_fit(lengths, length):
    """Bins (lists of indices) of a best-fit-decreasing packing."""
    tree, bins = Capacities(length + 1), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.pull(lengths[i])
        if found is None:
            bins.append([])
            found = length, bins[-1]
        room, mine = found
        mine.append(i)
        if room > lengths[i]:
            tree.put(room - lengths[i], mine)
    return bins


def pack(docs, vocabulary=None, length=2048, end_id=1, pad_id=0, text="text", key="doc_id", pool=2_000_000):
    """One row for each sequence (tokens.SEQUENCE): the padded id matrix row, positions that
    restart with each segment, cumulative segment lengths, and where each piece is from."""
    vocabulary = vocabulary or T.default_vocabulary()
    docs = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)

    def run(batches):
        encode = T.encoder(vocabulary)
        out = T.Writer((TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, length, pad_id, arrow)
        rest, held = [], 0
        def flush():
            for bin_ in best_fit([len(p[2]) for p in rest], length):
                out.add([rest[i] for i in bin_])
                if out.full():
                    yield out.take()
            rest.clear()
        for batch in batches:
            for doc, t in zip(batch["doc_id"], batch["text"]):
                ids = T.document_ids(t.as_py(), encode, end_id)
                n, doc = len(ids), doc.as_py()
                for s in range(0, n - n % length, length):
                    out.add([(doc, s, ids[s : s + length], n)])
                    if out.full():
                        yield out.take()
                if n % length:
                    rest.append((doc, n - n % length, ids[n - n % length :].copy(), n))
                    held += n % length
                    if held >= pool:
                        yield from flush()
                        held = 0
        yield from flush()
        yield out.take()

    return docs.mapInArrow(run, T.SEQUENCE.format(id=kind.simpleString()))
