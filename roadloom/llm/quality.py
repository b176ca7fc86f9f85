"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

A text's features are its runs of one, two and three words (lower case for A-Z; words are parted by white space), each hashed to one of
2^bits weights; values are counts, scaled so that every vector has one length. The option `again` (off by default, as held-out accuracy is as good
without: README) makes all pairs of equal neighbouring words one feature, so that the repetition of unseen words can be learned.

Training is per-coordinate FTRL-proximal in a fixed order on at most `max_rows` labelled texts of at most `max_bytes` together, chosen by a hash
of the id; these are the stated bounds on the fit and on the driver's memory. Scoring is a sparse dot product and a logistic link over whole texts.

Defined results: null and wordless texts have the score of the bias alone. Labels that are null or have no document are not
used; of several labels of an id all are used, and of several texts of an id all too, within the bounds. Without labels every score is 0.5.
An empty table gives an empty table. Rows with equal texts get equal scores. Columns named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import append_struct, chunks, stored, text_or_empty, trim
from roadloom.llm.words import LOWER, NOT_SPACE, hashes, mix, ngrams, spans

RESULTS = ["score"]
#: Length of a feature vector, and the longest run of words.
LENGTH, ORDER = 8.0, 3
_U = np.uint64


def _features(buf: np.ndarray, offs: np.ndarray, bits: int, again: bool = False):
    """(row, its distinct weights' places, their values) of a run of rows."""
    low = LOWER[buf]
    starts, ends, first = spans(low, offs, NOT_SPACE)
    w = hashes(low, starts, ends)
    grams = [mix((ngrams(w, k) if k > 1 else w) + _U(k)) >> _U(64 - bits) for k in range(1, ORDER + 1)]
    if again:
        grams[1][w[1:] == w[:-1]] = 0
    for r in range(len(offs) - 1):
        a, b = int(first[r]), int(first[r + 1])
        at, n = np.unique(np.concatenate([g[a : max(b - k, a)] for k, g in enumerate(grams)]), return_counts=True)
        yield r, at.astype(np.int64), LENGTH * n / max(np.sqrt((n * n).sum()), 1)


class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.02):
        self.z, self.n, self.w = (np.zeros(size) for _ in range(3))
        self.bias = self.bias_n = 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.w[at]
        p = 1 / (1 + np.exp(-np.clip(self.bias + (w * x).sum(), -30, 30)))
        g = p - label
        self.bias_n += g * g
        self.bias -= 0.1 * g / (1 + np.sqrt(self.bias_n))
        g = g * x
        n = self.n[at]
        rate = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - rate * w
        self.n[at] = n + g * g
        z = self.z[at]
        self.w[at] = np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))


def fit(docs: DataFrame, labels: DataFrame, bits: int = 18, max_rows: int = 6000, max_bytes: int = 128 << 20, epochs: int = 5, again: bool = False) -> tuple[np.ndarray, float]:
    """(weights, bias) from docs (doc_id, text) and labels (doc_id, quality)."""
    chosen = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("q"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "q").limit(max_rows)
    # max_rows ids at most, so they can be broadcast. The bounds are drawn by sizes and hashes; only then do the texts within them move.
    sized = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).withColumns({"h": F.xxhash64(F.lit(7), "doc_id"), "t": F.xxhash64("text")})
    first = sized.select("h", "q", "t", F.octet_length("text").cast("long").alias("n")).orderBy("h", "q", "t").limit(max_rows)
    first = first.withColumn("n", F.sum("n").over(Window.orderBy("h", "q", "t").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("n") <= max_bytes)
    kept = stored(first.groupBy("h", "q", "t").agg(F.count("*").alias("times")), "quality-kept")
    held = sized.join(F.broadcast(kept), ["h", "q", "t"]).select("h", "q", "t", "text", "times")

    def features(batches):
        met = set()  # copies in one partition
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in range(3))))
            new = [i for i, k in enumerate(keys) if not (k in met or met.add(k))]
            b = b.take(pa.array(new, pa.int64()))
            for i, j, buf, offs in chunks(b.column(3)):
                rows = [(at.astype(np.int32).tobytes(), x.astype(np.float32).tobytes()) for _, at, x in _features(buf, offs, bits, again)]
                yield pa.RecordBatch.from_arrays([*(b.column(c)[i:j] for c in (0, 1, 2, 4)), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))], ["h", "q", "t", "times", "at", "x"])

    rows = held.mapInArrow(features, "h long, q int, t long, times long, at binary, x binary").dropDuplicates(["h", "q", "t"]).toPandas().sort_values(["h", "q", "t"], kind="stable")
    rows = rows.loc[rows.index.repeat(rows["times"])]
    model = Ftrl(1 << bits)
    for _ in range(epochs):
        for at, x, q in zip(rows["at"], rows["x"], rows["q"], strict=True):
            model.learn(np.frombuffer(at, np.int32), np.frombuffer(x, np.float32), int(q))
    return model.w.astype(np.float32), model.bias


def score(docs: DataFrame, weights: np.ndarray, bias: float, again: bool = False) -> DataFrame:
    """docs with score, 0 to 1."""
    bits = len(weights).bit_length() - 1
    held = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("score double")
    def scored(text: pa.Array) -> pa.Array:
        w, out = held.value, []
        for _, _, buf, offs in chunks(text):
            for _, at, x in _features(buf, offs, bits, again):
                out.append(float(1 / (1 + np.exp(-np.clip(bias + float((w[at] * x).sum()), -30, 30)))))
        trim()
        return pa.StructArray.from_arrays([pa.array(out, pa.float64())], RESULTS)

    return append_struct(docs, scored.asNondeterministic()(text_or_empty()), RESULTS)
