"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics (shares by square root, counts by
logarithm).  For each class a mean and a covariance are learnt; the covariance is shrunk
towards the pooled one and towards a multiple of the identity, and its Cholesky factor is
computed once and kept with the model.  The score is the difference of the log densities
(squared Mahalanobis distances and log determinants), turned into a probability by a
logistic curve fitted on the same rows.

Learning uses at most `fit_rows` labelled rows, those whose key hashes lowest, so what
comes to the driver is bounded; statistics and scores cover every whole text.  Labels,
language, source and ids are not inputs.

Defined cases: null text is empty; texts without words have the statistics of an empty
text and are scored like any other; rows that repeat a doc_id are each scored; null labels
are left out; if only one class has labels the score is that class; without labels it is
0.5; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import kernels as K

# Byte classes whose shares are statistics.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:?",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"#$%&*@^_~<>{}[]\\/+=",
    "line": b"\n",
}
_CLASS = np.zeros(256, dtype=np.int64)
for _i, _c in enumerate(CLASSES.values()):
    _CLASS[list(_c)] = _i + 1
_CLASS[128:] = len(CLASSES) + 1
FEATURES = [*CLASSES, "other", "words", "word_bytes", "word_spread", "distinct", "repeat", "odd_end", "upper_words", "bytes"]


def statistics(column):
    """(rows, features) of the texts of an Arrow string column."""
    out = np.zeros((len(column), len(FEATURES)))
    kinds = len(CLASSES) + 2
    for a, b in K.slices(column):
        buf, off = K.flat(column.slice(a, b - a))
        n, size = b - a, np.diff(off)
        doc_of = np.repeat(np.arange(n), size)
        share = np.bincount(doc_of * kinds + _CLASS[buf], minlength=n * kinds).reshape(n, kinds) / np.maximum(size, 1)[:, None]
        s, e, doc = K.words(buf, off)
        words = np.bincount(doc, minlength=n)
        w1 = np.maximum(words, 1)
        long = (e - s).astype(np.float64)
        mean = np.bincount(doc, long, minlength=n) / w1
        spread = np.sqrt(np.maximum(np.bincount(doc, long * long, minlength=n) / w1 - mean * mean, 0))
        h = K.hashes(buf, s, e)
        same = np.zeros(len(h), dtype=bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n)
        last, first = (buf[e - 1], buf[s]) if len(s) else (buf[:0], buf[:0])
        odd = ~(((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128) | np.isin(last, list(b".,;:?")))
        cap = (first >= 65) & (first <= 90) & ((e - s) > 1)
        second = buf[np.minimum(s + 1, max(len(buf) - 1, 0))] if len(s) else buf[:0]
        cap &= (second >= 65) & (second <= 90)
        per = lambda x: np.bincount(doc, x, minlength=n) / w1
        f = [*np.sqrt(share[:, 1:]).T, np.log1p(words), np.log1p(mean), np.log1p(spread), distinct / w1, np.sqrt(per(same)), np.sqrt(per(odd)), np.sqrt(per(cap)), np.log1p(size)]
        out[a:b] = np.array(f).T
    return out


def fit(x, y, toward_pooled=0.1, toward_identity=0.02):
    """The model of rows x and labels y (0 or 1), as plain arrays."""
    classes = sorted(set(y.tolist()))
    if len(classes) < 2:
        return {"constant": 0.5 if not classes else float(classes[0])}
    centre, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - centre) / scale
    d = z.shape[1]
    pooled = sum(np.cov(z[y == k].T, bias=True) * (y == k).sum() for k in (0, 1)) / len(y)
    model = {"centre": centre, "scale": scale, "parts": []}
    for k in (0, 1):
        own = z[y == k]
        cov = (1 - toward_pooled) * np.cov(own.T, bias=True) + toward_pooled * pooled
        cov = (1 - toward_identity) * cov + toward_identity * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        low = np.linalg.cholesky(cov)
        model["parts"].append((own.mean(0), np.linalg.inv(low), 2 * np.log(np.diag(low)).sum()))
    delta = difference(model, x)
    w = np.array([np.log((y == 1).mean() / (y == 0).mean()), 1.0])
    a = np.stack([np.ones_like(delta), delta], 1)
    for _ in range(50):  # Newton steps of a lightly ridged logistic fit
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 1e-3 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    model["curve"] = w
    return model


def difference(model, x):
    """Log density of class 1 less that of class 0, squashed so that outliers stay finite."""
    z = (x - model["centre"]) / model["scale"]
    density = [-0.5 * ((((z - m) @ inv.T) ** 2).sum(1) + logdet) for m, inv, logdet in model["parts"]]
    t = density[1] - density[0]
    return np.sign(t) * np.log1p(np.abs(t))


def score(model, x):
    if "constant" in model:
        return np.full(len(x), model["constant"])
    a = np.clip(model["curve"][0] + model["curve"][1] * difference(model, x), -30, 30)
    return 1 / (1 + np.exp(-a))


def held_out(c):
    """Rows that no label is learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def measured(docs, text="text", key="doc_id"):
    """Rows doc_id, x: the statistics of every text, kept for training and scoring."""
    K.checkpoint_dir(docs.sparkSession)
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def measure(batches):
        for b in batches:
            x = statistics(b["text"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], lists], ["doc_id", "x"])

    return docs.mapInArrow(measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>").checkpoint()


def train(seen, labels, key="doc_id", label="quality", fit_rows=20_000):
    """The model of the statistics `seen` that have a label and are not held out."""
    marks = labels.select(F.col(key).cast(seen.schema["doc_id"].dataType).alias("doc_id"), F.col(label).alias("y")).filter(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    share = 2 * fit_rows / max(marks.count(), 1)
    while True:  # the lowest hashes are looked for among few rows, so that what one task sorts is bounded
        low = marks if share >= 1 else marks.filter(F.xxhash64("doc_id") < int(share * 2**64) - 2**63)
        rows = seen.join(low, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").select("x", "y").limit(fit_rows).toArrow()
        if share >= 1 or rows.num_rows == fit_rows:
            break
        share *= 4
    x = np.array(rows["x"].to_pylist(), dtype=np.float64).reshape(rows.num_rows, len(FEATURES))
    return fit(x, np.array(rows["y"].to_pylist(), dtype=np.int64))


def classify(docs, labels, text="text", key="doc_id", label="quality", threshold=0.3, fit_rows=20_000):
    """One row for each row of `docs`: key, held_out, score, predicted."""
    seen = measured(docs, text, key)
    model = train(seen, labels, key, label, fit_rows)

    def rate(batches):
        for b in batches:
            x = np.asarray(b["x"].flatten()).reshape(len(b["x"]), len(FEATURES))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(score(model, x))], ["doc_id", "score"])

    out = seen.mapInArrow(rate, f"doc_id {seen.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select(F.col("doc_id").alias(key), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs, labels, text="text", key="doc_id", label="quality", threshold=0.3, fit_rows=20_000):
    """The rows of `docs` whose score reaches the threshold; their texts don't move."""
    model = train(measured(docs, text, key), labels, key, label, fit_rows)
    rate = F.arrow_udf(lambda t: pa.array(score(model, statistics(t))), "double")
    return docs.filter(rate(F.col(text).cast("string")) >= threshold)
