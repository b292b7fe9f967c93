"""Names of strings, asked by blocks of texts and answered by ranges of names.

An operator that must know how often strings occur in the whole corpus, and has more of them
than rows could carry, asks in rounds:

1. `blocks` packs rows into compressed blocks of about `limit` bytes of text (one row at
   least), each with a number of its own.  They are exchanged once; Spark reuses that exchange
   for every round of one query.
2. A round's asker turns a block into its distinct sorted 64-bit names, with what else the
   answer needs, cut by ranges of names (`cut`).  A name is one entry a block however often it
   occurs there, so no name is hot.
3. The rows of a range (`ranges` many, by the size of the input, so that a range has about
   `PER_RANGE` names) meet in one task, which answers each entry.  The answers go back to the
   blocks; `answers` puts a block's together in the order of its names.

A block writes a row only for ranges in which it has names, so there are never more rows than
names: at the largest sizes this becomes the plain join of one row a name.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F

from . import kernels as K

BLOCK_BYTES = 8 << 20
PER_RANGE = 2_000_000
MOST_TASKS = 100_000
ASKED = "range int, block long, n int, body binary"
ANSWERED = "block long, range int, n int, body binary"


def text_bytes(docs, text="text"):
    """Bytes of text in all rows, counted on the JVM."""
    return docs.agg(F.sum(F.octet_length(text)).alias("bytes")).first()["bytes"] or 0


def ranges_for(spark, names):
    """A power of two of ranges, so that each has about PER_RANGE of so many names at most and
    each core has one."""
    n = max(-(-names // PER_RANGE), min(spark.sparkContext.defaultParallelism, 1 + names // 50_000))
    return 1 << max(0, int(n - 1).bit_length())


def by_range(asked, ranges):
    """Groups of the rows of a range; several ranges a task where there are very many."""
    return asked.repartition(min(ranges, MOST_TASKS), "range").groupBy("range")


def blocks(docs, kind, size, limit=None):
    """Rows block, ids, sizes, texts from rows doc_id, text, exchanged by block; null text is
    empty.  `size`: the bytes of text in all; small inputs have smaller blocks, for all cores."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    limit = limit or min(BLOCK_BYTES, max(1 << 18, size // (4 * cores)))
    tasks = min(MOST_TASKS, max(1, size // limit))

    def pack(batches):
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        ids, sizes, data, held = [], [], [], 0

        def close():
            nonlocal ids, sizes, data, held, number
            column = pa.chunked_array(ids).combine_chunks()
            one = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
            body = zstandard.ZstdCompressor(level=1).compress(b"".join(data))
            row = pa.RecordBatch.from_arrays([pa.array([number]), one, pa.array([np.concatenate(sizes).astype("<i8").tobytes()], pa.binary()), pa.array([body], pa.binary())], ["block", "ids", "sizes", "texts"])
            ids, sizes, data, held, number = [], [], [], 0, number + 1
            return row

        for batch in batches:
            for a, b in K.slices(batch["text"]):
                buf, off = K.flat(batch["text"].slice(a, b - a))
                if held and held + len(buf) > limit:
                    yield close()
                ids.append(batch["doc_id"].slice(a, b - a))
                sizes.append(np.diff(off))
                data.append(buf.tobytes())
                held += len(buf)
        if ids:
            yield close()

    return docs.select("doc_id", "text").mapInArrow(pack, f"block long, ids array<{kind}>, sizes binary, texts binary").repartition(tasks, "block")


def opened(t):
    """For each block of a table: (block number, ids, bytes, offsets)."""
    for i in range(t.num_rows):
        sizes = np.frombuffer(t["sizes"][i].as_py(), "<i8")
        off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        raw = zstandard.ZstdDecompressor().decompress(t["texts"][i].as_py(), max_output_size=max(int(off[-1]), 1))
        yield t["block"][i].as_py(), t["ids"][i].values, np.frombuffer(raw, np.uint8), off


def cut(keys, ranges):
    """(range, first, end) of the runs of sorted keys that fall into one range each."""
    if not len(keys):
        return []
    part = (keys >> np.uint64(65 - ranges.bit_length())).astype(np.int64) if ranges > 1 else np.zeros(len(keys), np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    return list(zip(part[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)]))


def ask(block, ranges, keys, *more):
    """Rows of ASKED: sorted keys and the arrays that go with them, packed by range."""
    rows = []
    for r, a, b in cut(keys, ranges):
        parts = [K.pack_sorted(keys[a:b]), *(K.pack(m[a:b]) for m in more)]
        rows.append((r, block, b - a, join_parts(parts)))
    cols = list(zip(*rows)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["range", "block", "n", "body"])


def join_parts(parts):
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def split_parts(body, count):
    at, out = 4 * count, []
    for size in np.frombuffer(body[: 4 * count], "<u4").tolist():
        out.append(body[at : at + size])
        at += size
    return out


def asked(t, *dtypes):
    """The entries of a range: sorted order is that of the rows, (keys, arrays ...)."""
    cols = [[] for _ in range(len(dtypes) + 1)]
    for n, body in zip(t["n"].to_pylist(), t["body"].to_pylist()):
        parts = split_parts(body, len(dtypes) + 1)
        cols[0].append(K.unpack_sorted(parts[0], n))
        for c, p, d in zip(cols[1:], parts[1:], dtypes):
            c.append(K.unpack(p, n, d))
    return [np.concatenate(c) for c in cols]


def answer(t, keep, *values):
    """Rows of ANSWERED: arrays with a value for each entry of `t`, in order; only the entries
    of the mask `keep`, if it is given.  Arrays of names must be first and are kept sorted."""
    n = t["n"].to_numpy()
    ends = np.cumsum(n)
    kept, body = [], []
    for e, k in zip(ends.tolist(), n.tolist()):
        mine = slice(e - k, e)
        parts = [v[mine] if keep is None else v[mine][keep[mine]] for v in values]
        kept.append(len(parts[0]))
        body.append(join_parts([K.pack_sorted(p) if p.dtype == np.uint64 else K.pack(p) for p in parts]))
    return pa.table([t["block"], t["range"], pa.array(kept, pa.int32()), pa.array(body, pa.binary())], ["block", "range", "n", "body"])


def answers(t, block, *dtypes):
    """The arrays that a block was given, in the order of its names."""
    mine = sorted((r, n, b) for k, r, n, b in zip(*(t[c].to_pylist() for c in ("block", "range", "n", "body"))) if k == block)
    out = [[np.zeros(0, np.dtype(d))] for d in dtypes]
    for _, n, body in mine:
        for o, p, d in zip(out, split_parts(body, len(dtypes)), dtypes):
            o.append(K.unpack_sorted(p, n) if np.dtype(d) == np.uint64 else K.unpack(p, n, d))
    return [np.concatenate(o) for o in out]


def repeated(names, seen):
    """For each entry whether its name stands for two places or more; `seen`: the entry's own
    block has it twice or more."""
    order = np.argsort(names)
    first = np.ones(len(names), dtype=bool)
    first[1:] = names[order][1:] != names[order][:-1]
    group = np.cumsum(first) - 1
    many = np.bincount(group, weights=1.0 + seen[order]) > 1.5
    out = np.empty(len(names), dtype=bool)
    out[order] = many[group]
    return out
