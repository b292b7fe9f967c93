"""Stupid-backoff language-model scores, computed relationally.

A block of texts explodes into its n-grams of 1 to `order` words and asks, in one round of
`naming`, with each distinct n-gram's 60-bit name and its count in the block; the count tables
are partitioned by ranges of the hash, and a range adds up the counts of its names.  The corpus
counts go back to the blocks, where they are joined to the exploded n-grams, less the
document's own counts, and summed per document:

    score(w | h) = c(h w) / c(h)  if c(h w) > 0,  else  backoff * score(w | shorter h)

with c(w) / N for one word and 1 / (N + 1) for a word that no other document has.  Counts have
64 bits throughout.  Names have 60 bits (each bit is an eighth of a byte of shuffle an n-gram)
and are not verified: at 10^13 different n-grams about one in a hundred thousand shares its
name with another, whose count it then adds to its own.

Defined cases: null or empty text has 0 words and score 0; a text of one word has only its
single-word score; with one document every word is unknown; rows that repeat a doc_id, or have
none, are separate documents; ties don't occur; other columns, whatever their names, are
ignored; an empty table gives an empty result; a block has one document at least, so a very
long text is held whole, at some 20 bytes a byte beside its n-grams.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import kernels as K
from . import naming as N

SIXTY = np.uint64(2**64 - 16)


def ngrams(buf, off, order):
    """(doc, place, [names of the n-grams that end at each word, n = 1..order])."""
    h, doc = K.hashed_words(buf, off)
    n = np.bincount(doc, minlength=len(off) - 1)
    place = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
    g = K.mix(h + np.uint64(1))
    names = [g]
    for k in range(1, order):
        back = np.zeros_like(g)
        back[1:] = g[:-1]
        g = K.mix(back * np.uint64(3) + h + np.uint64(k + 1))  # names that cross texts are never read
        names.append(g)
    return doc, place, [g & SIXTY for g in names]


def table(place, names):
    """Sorted distinct names of a block and their counts."""
    return np.unique(np.concatenate([g[place >= k] for k, g in enumerate(names)]), return_counts=True)


def numbered(place, names):
    """For each order the numbers of its n-grams among the block's sorted names; where a word
    has no n-gram of that order, a number of its own, one past the last."""
    here = [place >= k for k in range(len(names))]
    flat = np.concatenate([g[ok] for g, ok in zip(names, here)])
    order = np.argsort(flat)
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[order][1:] != flat[order][:-1]
    number = np.empty(len(flat), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    out, a, count = [], 0, int(new.sum())
    for ok in here:
        at = np.full(len(ok), count)
        n = int(ok.sum())
        at[ok] = number[a : a + n]
        out.append(at)
        a += n
    return out, count


def document_scores(buf, off, order, totals, n_words, backoff):
    """(words, log score) of each text, given the corpus counts of the block's sorted names."""
    doc, place, names = ngrams(buf, off, order)
    at, count = numbered(place, names)
    totals = np.append(totals, 0)
    other = []
    for k, a in enumerate(at):  # counts in the other documents
        _, inv, own = np.unique(doc * (count + 1) + a, return_inverse=True, return_counts=True)
        c = np.where(place >= k, totals[a] - own[inv], 0) if len(a) else np.zeros(0, np.int64)
        other.append(c)
    words = np.bincount(doc, minlength=len(off) - 1)
    left = (n_words - words)[doc]
    out = np.full(len(doc), np.nan)
    for n in range(order, 0, -1):
        c = other[n - 1]
        if n > 1:
            h = np.zeros_like(c)
            h[1:] = other[n - 2][:-1]
        else:
            h = left
        use = np.isnan(out) & (c > 0)
        lost = np.minimum(place, order - 1) - (n - 1)  # steps back from the longest history
        out[use] = np.log(c[use] / h[use]) + lost[use] * np.log(backoff)
    use = np.isnan(out)
    out[use] = -np.log(left[use] + 1.0) + np.minimum(place, order - 1)[use] * np.log(backoff)
    return words, np.bincount(doc, out, minlength=len(off) - 1)


def summed(keys, counts):
    """For each entry of a range the corpus count of its name."""
    order = np.argsort(keys)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    total = np.add.reduceat(counts[order], np.flatnonzero(new)) if len(keys) else counts
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = total[np.cumsum(new) - 1]
    return out


def backoff_scores(docs, order=3, backoff=0.4, text="text", key="doc_id", block_bytes=None):
    """One row for each row of `docs`: key, n_words, log_score (natural), mean_log_score."""
    docs = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    spark, kind, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(K.word_counts(b["text"]).sum())]), pa.array([len(K.flat(b["text"])[0])])], ["words", "bytes"])

    n_words, size = docs.select("text").mapInArrow(count, "words long, bytes long").agg(F.sum("words"), F.sum("bytes")).first()
    n_words, size = n_words or 0, size or 0
    packed = N.blocks(docs, kind, size, block_bytes)
    ranges = N.ranges_for(spark, n_words * order)

    def ask(t):
        return pa.concat_tables(N.ask(n, ranges, *table(*ngrams(buf, off, order)[1:])) for n, _, buf, off in N.opened(t))

    def add(t):
        return N.answer(t, None, summed(*N.asked(t, "<i8")))

    def scores(t, told):
        out = [pa.table([pa.array([], x) for x in (id_type, pa.int64(), pa.float64())], ["doc_id", "n_words", "log_score"])]
        for n, ids, buf, off in N.opened(t):
            words, log = document_scores(buf, off, order, N.answers(told, n, "<i8")[0], n_words, backoff)
            out.append(pa.table([ids.cast(id_type), pa.array(words, pa.int64()), pa.array(log, pa.float64())], ["doc_id", "n_words", "log_score"]))
        return pa.concat_tables(out)

    totals = N.by_range(packed.groupBy("block").applyInArrow(ask, N.ASKED), ranges).applyInArrow(add, N.ANSWERED)
    out = packed.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(scores, f"doc_id {kind}, n_words long, log_score double")
    return out.select(F.col("doc_id").alias(key), "n_words", "log_score", F.try_divide("log_score", "n_words").alias("mean_log_score"))
