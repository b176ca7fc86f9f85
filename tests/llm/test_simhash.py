"""Fingerprints bit by bit, masks pair by pair, classes against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from roadloom.llm import simhash
from roadloom.llm.classes import components

R = random.Random(3)
WORDS = ["".join(R.choices("abcdeéÜZ", k=R.randint(1, 7))) for _ in range(300)]
BASE = [" ".join(R.choices(WORDS, k=R.randint(60, 200))) for _ in range(12)]


def near(t, n):
    w = t.split()
    for _ in range(n):
        w[R.randrange(len(w))] = R.choice(WORDS)
    return "  ".join(w)


TEXTS = [*BASE, *[near(R.choice(BASE), R.randint(0, 4)) for _ in range(120)], None, "", "\t \n", "one", "One", "a b c", "a b c d", "\u0085x\xa0y", " ".join(R.choices(WORDS, k=70_000)), "the same line again \n" * 500]
ROWS = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(2, "another text of one id", "clash"), (None, BASE[0], "clash"), (None, "without an id and alone", "clash")]


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(rows, radius):
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[top(i)] = top(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(((r[0], f"{p:016x}", least.get(top(i))) for i, (r, p) in enumerate(zip(rows, prints))), key=str)


@pytest.mark.parametrize(("radius", "bucket"), [(4, 2048), (4, 2), (2, 3)])
def test_near_duplicates(spark, radius, bucket):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, FP string").repartition(3)
    got = simhash.near_duplicates(docs, 4, radius, bucket).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_classes(ROWS, radius)


def test_spark_has_the_same_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("one two three four"))).first()[0] == np.uint64(xxhash.xxh64_intdigest(b"one two three four", 42)).view(np.int64)


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover_every_pair(radius):
    masks = simhash.covering(radius)
    again = simhash.covering(radius, masks[0])
    open_ = [i for i in range(64) if not masks[0] >> i & 1]
    for _ in range(5000):
        gap = sum(1 << p for p in R.sample(range(64), radius))
        assert any(not m & gap for m in masks)
        gap = sum(1 << p for p in R.sample(open_, radius))
        assert any(not m & gap for m in again)
    assert all(m & masks[0] == masks[0] and m != masks[0] for m in again)


@pytest.mark.parametrize("bucket", [2048, 50])
def test_a_dense_ball_is_one_class(spark, bucket):
    """Hundreds of fingerprints round one centre share a bucket in every table."""
    centre = 0x0123456789ABCDEF
    ball = {centre} | {centre ^ sum(1 << p for p in R.sample(range(64), R.randint(1, 4))) for _ in range(600)}
    far = {R.getrandbits(64) for _ in range(300)}
    nodes = spark.createDataFrame([(simhash._signed(x),) for x in ball | far], "fp long")
    got = components(simhash.links(nodes, 4, bucket)).groupBy("root").count().collect()
    assert max(r["count"] for r in got) == len(ball) - 1  # the root has no row


def test_components_of_a_star(spark):
    links = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).union(spark.createDataFrame([(7000, 7001), (7001, 7002), (5, 5)], "a long, b long"))
    got = {r.id: r.root for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 3000)) and {got[i] for i in (7001, 7002)} == {7000}


def test_no_documents(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
