"""Language identification by the nearest of several TF-IDF centroids per language.

A text becomes a vector of hashed byte trigrams of its letters (ASCII lower case, every run
of other ASCII characters one space): (1 + log count) * idf, L2-normalised. Each language has up
to `clusters` centroids from spherical k-means; a text takes the language of the centroid of
the largest cosine. It is rejected when that cosine is below the limit for a text of its size in that language. Sizes are
powers of two of different trigrams. A limit is a share of the lowest percent of the cosines of training texts and of runs of words
cut from them (one word and more), each to centroids that were made without its text.
It is rejected too when less than an eighth of its weight (squared) lies on trigrams that training texts of that language have.

Defined results: a null text, or one without any letter, is `und` with score 0 and rejected. Ties go to
the language that sorts first. Rows with equal texts get equal results. Without a single training text every
row is `und`. An empty table gives an empty table. Columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import append_struct, chunks, text_or_empty, trim

RESULTS = ["lang_pred", "score", "rejected"]
_SPACED = np.full(256, 32, dtype=np.uint8)
_SPACED[97:123] = np.arange(97, 123)
_SPACED[65:91] = np.arange(97, 123)
_SPACED[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class CentroidModel:
    langs: list[str]
    of: np.ndarray  # language index of each centroid
    centroids: np.ndarray  # dims x centroids
    limits: np.ndarray  # languages x sizes, least cosine
    known: np.ndarray  # languages x dims, trigrams of its training texts
    idf: np.ndarray


def _counts(buf: np.ndarray, offs: np.ndarray, dims: int):
    """(row, counts of its hashed trigrams) of a run of rows."""
    for r in range(len(offs) - 1):
        b = _SPACED[buf[offs[r] : offs[r + 1]]]
        if len(b):
            keep = np.ones(len(b), dtype=bool)
            keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
            b = b[keep].astype(np.uint32)
            b = np.concatenate(([32], b, [32])).astype(np.uint32)
            code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
            code = (code * np.uint32(2654435761)) >> np.uint32(32 - (dims.bit_length() - 1))
            yield r, np.bincount(code, minlength=dims)
        else:
            yield r, np.zeros(dims, dtype=np.int64)


def _vectors(buf, offs, idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(offs) - 1, len(idf)), dtype=np.float32)
    for r, c in _counts(buf, offs, len(idf)):
        at = np.flatnonzero(c)
        out[r, at] = (1 + np.log(c[at])) * idf[at]
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and the one of each text. The starts are the text nearest the mean and then, of the half of the texts that is nearest
    the mean, the farthest from those chosen. A centroid of fewer texts than a tenth of an even share (or than two) is given up."""
    middle = x @ x.mean(axis=0)
    typical = np.flatnonzero(middle >= np.median(middle))
    start = [int(np.argmax(middle))]
    near = x[typical] @ x[start[0]]
    while len(start) < min(k, len(typical)):
        start.append(int(typical[np.argmin(near)]))
        near = np.maximum(near, x[typical] @ x[start[-1]])
    c = x[start]
    least = max(2, len(x) // (10 * k))
    while True:
        for _ in range(rounds):
            own = np.argmax(x @ c.T, axis=1)
            c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(x @ c.T, axis=1)
        held = np.bincount(own, minlength=len(c))
        if len(c) == 1 or held.min() >= least:
            return c, own
        c = np.delete(c, np.argmin(held), axis=0)


def _pieces(text: bytes) -> list[bytes]:
    """The text, and runs of 1 to 32 of its words: four of each length, evenly spread."""
    words = _SPACED[np.frombuffer(text, np.uint8)].tobytes().split()
    out = [text]
    for n in (1, 2, 4, 8, 16, 32):
        if n < len(words):
            out += [b" ".join(words[i : i + n]) for i in sorted({int(i) for i in np.linspace(0, len(words) - n, 4)})]
    return out


def _sizes(v: np.ndarray) -> np.ndarray:
    """The power of two of different trigrams of each vector."""
    return np.array([max(int(np.count_nonzero(r)), 1).bit_length() - 1 for r in v])


def _limits(x: np.ndarray, pieces: Iterable[np.ndarray], c: np.ndarray, own: np.ndarray, share: float) -> np.ndarray:
    """Least cosine for each size. x: the texts' vectors; pieces: the vectors of each text's pieces.

    Cosine grows about as the root of the size: a size seen less than 20 times takes its limit by that law from the next larger one that
    was seen more often, and a larger one than all of these the limit of the largest. Without any, nothing is rejected.
    """
    total = np.stack([x[own == j].sum(axis=0) for j in range(len(c))])
    seen: list[list[float]] = [[] for _ in range(x.shape[1].bit_length())]
    for r, p in enumerate(pieces):
        others = c.copy()
        rest = total[own[r]] - x[r]
        norm = np.linalg.norm(rest)
        if norm <= 1e-3 and len(c) == 1:
            continue
        others[own[r]] = rest / norm if norm > 1e-3 else 0
        for size, cos in zip(_sizes(p), (p @ others.T).max(axis=1), strict=True):
            seen[size].append(float(cos))
    out, larger = np.zeros(len(seen)), 0.0
    known = [s for s in range(len(seen)) if len(seen[s]) >= 20]
    for s in range(len(seen) - 1, -1, -1):
        if s in known:
            out[s] = share * float(np.quantile(seen[s], 0.01))
        elif known:
            out[s] = larger / np.sqrt(2) if s < known[-1] else share * float(np.quantile(seen[known[-1]], 0.01))
        larger = out[s]
    return out


def _foreign(m: CentroidModel, lang: int, v: np.ndarray, cos: float) -> bool:
    at = np.flatnonzero(v)
    return bool(cos < m.limits[lang, max(len(at), 1).bit_length() - 1] or np.square(v[at][m.known[lang, at]]).sum() < 0.125)


def _dense(v: bytes, places: bytes, sizes: bytes, dims: int, first: int | None = None) -> np.ndarray:
    """The vectors of a text and its pieces, or the first few of them, in an array of no more rows than that."""
    n = np.frombuffer(sizes, np.uint32)[:first]
    held = int(n.sum())
    out = np.zeros((len(n), dims), np.float32)
    out[np.repeat(np.arange(len(n)), n), np.frombuffer(places, np.uint32)[:held]] = np.frombuffer(v, np.float32)[:held]
    return out


def fit(labelled: DataFrame, dims: int = 4096, clusters: int = 4, sample_per_lang: int = 500, reject_share: float = 0.25) -> CentroidModel:
    """Learns from columns text and lang.

    Document frequencies cover every labelled row. The centroids are fitted on a sample of about
    `sample_per_lang` different texts of each language (chosen by a hash of the text; all where there are no more), each once however often
    it is repeated, so what reaches the driver is about sample_per_lang * languages vectors of `dims` floats, and short ones of their pieces, whatever the size of the corpus.
    """
    rows = labelled.select(text_or_empty().alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null").where(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    counted = rows.groupBy("lang", "h").agg(F.count("*").alias("n")).groupBy("lang").agg(F.count("*").alias("texts"), F.sum("n").alias("n")).collect()
    per_lang = {r["lang"]: r["n"] for r in counted}
    if not per_lang:
        return CentroidModel([], np.zeros(0, np.int64), np.zeros((dims, 0), np.float32), np.zeros((0, dims.bit_length())), np.zeros((0, dims), bool), np.ones(dims))

    def frequency(batches):
        total = np.zeros(dims, dtype=np.int64)
        for b in batches:
            for _, _, buf, offs in chunks(b.column(0)):
                for _, c in _counts(buf, offs, dims):
                    total += c > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(total)], ["d", "n"])

    df = np.zeros(dims)
    for r in rows.select("text").mapInArrow(frequency, "d long, n long").groupBy("d").agg(F.sum("n").alias("n")).collect():
        df[r["d"]] = r["n"]
    idf = np.log((1 + sum(per_lang.values())) / (1 + df)) + 0.05

    share = F.create_map(*[x for k, n in sorted((r["lang"], r["texts"]) for r in counted) for x in (F.lit(k), F.lit(min(1.0, sample_per_lang / n)))])
    sample = rows.where((F.pmod("h", F.lit(1 << 40)) / (1 << 40)) < share[F.col("lang")])

    def vectors(batches):
        met = set()  # copies in one partition
        for b in batches:
            langs, texts, hashes = b.column(1).to_pylist(), b.column(0).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()
            for lang, text, h in zip(langs, texts, hashes, strict=True):
                if (lang, h) in met:
                    continue
                met.add((lang, h))
                _, _, buf, offs = next(chunks(pa.array([p.decode() for p in _pieces(text)]), limit=1 << 62))  # 25 pieces at most
                v = _vectors(buf, offs, idf)
                at = [np.flatnonzero(r) for r in v]
                sizes = np.array([len(i) for i in at], np.uint32)
                values = np.concatenate([r[i] for r, i in zip(v, at, strict=True)])
                row = [lang, sizes.tobytes(), np.concatenate(at).astype(np.uint32).tobytes(), values.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([h]), *[pa.array([c], pa.binary()) for c in row[1:]]], ["lang", "h", "sizes", "places", "v"])

    by_lang: dict[str, list[tuple[bytes, bytes, bytes]]] = {}
    for r in sample.mapInArrow(vectors, "lang string, h long, sizes binary, places binary, v binary").dropDuplicates(["lang", "h"]).toLocalIterator():
        by_lang.setdefault(r["lang"], []).append((bytes(r["v"]), bytes(r["places"]), bytes(r["sizes"])))

    langs, of, cs, limits, known = sorted(by_lang), [], [], [], []
    for k, lang in enumerate(langs):
        packed = sorted(by_lang[lang])
        x = np.concatenate([_dense(*p, dims, first=1) for p in packed])  # without the pieces: theirs are made one text at a time
        c, own = _kmeans(x, clusters)
        of += [k] * len(c)
        cs += list(c)
        known.append((x > 0).any(axis=0))
        limits.append(_limits(x, (_dense(*p, dims) for p in packed), c, own, reject_share))
    return CentroidModel(langs, np.array(of), np.stack(cs).T.astype(np.float32), np.array(limits), np.array(known), idf)


def identify(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """docs with lang_pred, score (cosine, 0 to 1) and rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def predict(text: pa.Array, lettered: pa.Array) -> pa.Array:
        m = held.value
        lang, score, out = [], [], []
        for i, j, buf, offs in chunks(text):
            has = lettered[i:j].to_numpy(zero_copy_only=False)
            v = _vectors(buf, offs, m.idf)
            cos = v @ m.centroids if m.langs else np.zeros((j - i, 1), np.float32)
            best = cos.argmax(axis=1)
            top = np.clip(cos[np.arange(j - i), best].astype(float), 0, 1)
            for r in range(j - i):
                known = bool(has[r]) and bool(m.langs)
                lang.append(m.langs[m.of[best[r]]] if known else "und")
                score.append(float(top[r]) if known else 0.0)
                out.append(not known or _foreign(m, m.of[best[r]], v[r], top[r]))
        trim()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], RESULTS)

    text = text_or_empty()
    return append_struct(docs, predict.asNondeterministic()(text, text.rlike(r"\p{L}")), RESULTS)


def accepted(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """The documents that are not rejected, with the columns of docs; those named like a result are kept too."""
    told = identify(docs.withColumns({f"__kept_{c}": docs[f"`{c}`"] for c in docs.columns if c.lower() in RESULTS}), model).where("not rejected")
    return told.select(*[F.col(f"`__kept_{c}`").alias(c) if c.lower() in RESULTS else F.col(f"`{c}`") for c in docs.columns])
