"""The language classifier and the quality classifier against plain re-computation, number by number."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.llm import language_id, quality

R = random.Random(6)
WORDS = {lang: ["".join(R.choices(letters, k=R.randint(1, 8))) for _ in range(120)] for lang, letters in (("aa", "abcdeéf"), ("bb", "ghijklüm"), ("cc", "nopqrst"))}


def text(lang, n):
    return "  ".join(R.choices(WORDS[lang], k=n))


DIMS = 1024


def plain_vector(t, idf):
    """TF-IDF of hashed trigrams, counted one by one."""
    raw = bytearray()
    for b in t.encode():
        c = b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
        if not (c == 32 and raw and raw[-1] == 32):
            raw.append(c)
    if not t:
        return {}, Counter()
    raw = bytes([32]) + bytes(raw) + bytes([32])
    n = Counter(((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32) >> 22 for i in range(len(raw) - 2))
    v = {k: (1 + math.log(c)) * idf[k] for k, c in n.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / norm for k, x in v.items()}, n


@pytest.fixture(scope="module")
def languages(spark):
    rows = [(text(lang, R.randint(1, 60)), lang) for lang in WORDS for _ in range(80)]
    rows += [(rows[0][0], "aa")] * 5 + [(None, "aa"), ("123", "bb"), ("no language", None)]
    return rows, language_id.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3), dims=DIMS, clusters=3)


def test_document_frequencies(languages):
    rows, model = languages
    used = [t for t, lang in rows if lang and t and any(c.isalpha() for c in t)]
    df = Counter(k for t in used for k in plain_vector(t, np.ones(DIMS))[1])
    assert model.idf == pytest.approx([math.log((1 + len(used)) / (1 + df[k])) + 0.05 for k in range(DIMS)])


def test_predictions_are_the_nearest_centroids(spark, languages):
    """Cosines, the nearest centroid, its language, and the two grounds for rejection, from the model's numbers by plain sums."""
    _, model = languages
    texts = [text(lang, n) for lang in WORDS for n in (1, 2, 5, 40, 400)] + [text("aa", 10) + " " + text("cc", 10), "zzz xyz wv", "ÄÖ ñandú", "", None, "12 34", "a"]
    got = {r.i: r for r in language_id.identify(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model).collect()}
    for i, t in enumerate(texts):
        v, n = plain_vector(t or "", model.idf)
        if not t or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        cos = [sum(x * float(model.centroids[k, c]) for k, x in v.items()) for c in range(model.centroids.shape[1])]
        best = max(range(len(cos)), key=lambda c: (round(cos[c], 6), -c))
        lang = int(model.of[best])
        assert got[i].lang_pred == model.langs[lang] and got[i].score == pytest.approx(min(max(cos[best], 0), 1), abs=1e-5)
        met = sum(x * x for k, x in v.items() if model.known[lang, k])
        assert got[i].rejected == (cos[best] < model.limits[lang, len(n).bit_length() - 1] or met < 0.125)


def test_one_round_of_centroids():
    """Two clear clusters: centroids are the unit means of the texts nearest to them."""
    x = np.array([[1, 0.1, 0], [1, 0.2, 0], [0.9, 0.1, 0.1], [0, 0.1, 1], [0.1, 0, 1], [0, 0.2, 0.9], [0.1, 0.1, 1]], dtype=np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, own = language_id._kmeans(x, 2)
    for j in range(2):
        mean = np.mean([x[i] for i in range(len(x)) if own[i] == j], axis=0)
        assert c[j] == pytest.approx(mean / np.linalg.norm(mean), abs=1e-6)
    assert sorted(Counter(own.tolist()).values()) == [3, 4] and all(max(range(2), key=lambda j: float(x[i] @ c[j])) == own[i] for i in range(len(x)))


def test_weights_are_those_of_plain_ftrl(spark):
    """Each weight by the per-coordinate rule over dictionaries, in the order of the hashes, epoch by epoch."""
    docs = [(i, text(("aa", "bb")[i % 2], R.randint(0, 30))) for i in range(60)] + [(3, "a second text of one id"), (3, "a second text of one id"), (61, None)]
    labels = [(i, i % 2 if i % 7 else 1 - i % 2) for i in range(0, 62)] + [(2, 1), (500, 1), (5, None), (None, 1)]
    d, ls = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")
    weights, bias = quality.fit(d, ls, bits=12, epochs=3)
    pairs = d.join(ls, "doc_id").where("quality is not null").select(F.xxhash64(F.lit(7), "doc_id").alias("h"), F.col("quality").alias("q"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    rows = sorted((tuple(r) for r in pairs.collect()))
    assert len(rows) == 64
    z, n, w = defaultdict(float), defaultdict(float), defaultdict(float)
    b = bn = 0.0
    for _ in range(3):
        for _, q, _, t in rows:
            raw = t.encode()
            (_, at, x), = quality._features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 12) if raw else [(0, np.zeros(0, int), np.zeros(0))]
            words = t.lower().split()
            grams = Counter(" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
            assert len(at) <= len(grams) and (not len(x) or np.sqrt((x * x).sum()) == pytest.approx(8))
            f = {int(k): float(np.float32(v)) for k, v in zip(at, x)}
            p = 1 / (1 + math.exp(-max(-30, min(30, b + sum(w[k] * v for k, v in f.items())))))
            g = p - q
            bn += g * g
            b -= 0.1 * g / (1 + math.sqrt(bn))
            for k, v in f.items():
                gk = g * v
                z[k] += gk - (math.sqrt(n[k] + gk * gk) - math.sqrt(n[k])) / 0.5 * w[k]
                n[k] += gk * gk
                w[k] = 0.0 if abs(z[k]) <= 0.01 else -(z[k] - math.copysign(0.01, z[k])) / ((1 + math.sqrt(n[k])) / 0.5 + 0.02)
    assert bias == pytest.approx(b, abs=1e-6)
    assert weights == pytest.approx([w[k] for k in range(1 << 12)], abs=1e-5)
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame([(1, docs[1][1]), (2, "")], "doc_id long, text string"), weights, bias).collect()}
    assert got[2] == pytest.approx(1 / (1 + math.exp(-b)), abs=1e-6)


def test_bounds_are_drawn_before_texts_move(spark):
    docs = spark.createDataFrame([(i, "word " * 1000) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    few, _ = quality.fit(docs, labels, bits=10, max_bytes=12_000)
    none, bias = quality.fit(docs, labels, bits=10, max_bytes=10)
    assert np.count_nonzero(few) > 0 and not none.any() and bias == 0.0


def test_the_first_vector_of_a_text_holds_no_memory_of_its_pieces():
    sizes, places, v = np.array([2, 1, 3], np.uint32), np.array([1, 5, 0, 2, 3, 4], np.uint32), np.arange(1, 7, dtype=np.float32)
    packed = (v.tobytes(), places.tobytes(), sizes.tobytes())
    whole, first = language_id._dense(*packed, 8), language_id._dense(*packed, 8, first=1)
    assert whole.shape == (3, 8) and first.base is None and first.nbytes == 8 * 4
    assert (whole[0] == first[0]).all() and whole[2].tolist() == [0, 0, 4, 5, 6, 0, 0, 0]
