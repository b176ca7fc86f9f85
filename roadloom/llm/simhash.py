"""Near duplicates by SimHash fingerprints, found with covering locality-sensitive hashing.

A text's fingerprint has a bit set where over half the XXH64 hashes of its word shingles have it. Different fingerprints
are the nodes. For a radius r every bit place gets a non-zero vector of r + 1 bits; the mask of a vector v keeps
the places whose vectors have an odd product with v. Two fingerprints that differ in r places at most agree on some
mask: the vectors of those places span at most r dimensions, so some v is orthogonal to all of them. So every
linked pair meets in a bucket of one of the 2^(r+1) - 1 masks, and no other comparison is needed.

A bucket of up to `BUCKET` nodes is searched in one task, which gives links that join what is connected, not all
pairs. The nodes of a larger one are dealt out once more by masks of the same kind over the places that its mask
leaves open. A mask keeps half of these, so that buckets of the third round are small whatever the table.

Defined results: null, empty and wordless texts have the fingerprint zero and are linked like any other. Equal
fingerprints, whatever the texts, are one node. Rows that repeat an id are separate rows. A row without an id
takes the least id of its class, null if that has none. Other columns are not looked at. No rows give no rows.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.classes import components
from roadloom.llm.common import stored, text_or_empty, trimmed, with_fact

BITS, SEED = 64, 42
#: Largest bucket that one task searches before its nodes are dealt out again.
BUCKET = 2048
#: Rounds of masks. The last leaves about 8 places open, so that its buckets hold some hundred different nodes at most.
ROUNDS = 3
#: Has no divisor in common with any 2^n - 1 in use.
STRIDE = 11
#: Shingles whose hashes are held at once.
PIECE = 1 << 16


def fingerprint(text: str, k: int = 4) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - k + 1, 1)
    starts, ends = starts[:n].tolist(), ends[len(words) - n :].tolist()
    ones, hashed = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, PIECE):
        h = np.array([hashed(line[s:e], SEED) for s, e in zip(starts[i : i + PIECE], ends[i : i + PIECE])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), k) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, fp long")


def covering(radius: int, fixed: int = 0) -> list[int]:
    """The masks over the places that `fixed` leaves open, each joined with it."""
    vectors = (1 << radius + 1) - 1
    places = [i for i in range(BITS) if not fixed >> i & 1]
    # The stride deals out vectors so that those of few places, too, span all dimensions: no mask is then without a place.
    return [fixed | sum(1 << p for j, p in enumerate(places) if (j * STRIDE % vectors + 1 & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


def _tables(spark: SparkSession, radius: int, fixed: list[int]) -> DataFrame:
    """mask and further masks of each of the given ones: their number depends on the radius and the round alone."""
    return spark.createDataFrame([(_signed(f), [_signed(m) for m in covering(radius, f)]) for f in fixed], "mask long, masks array<long>")


def joined(nodes: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is within the radius: each node is compared with those not yet reached."""
    left, out = nodes, []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                out.append((np.full(len(found), x), found))
                front.extend(found)
                left = left[~near]
    return out


def _search(batches, radius: int):
    """Links (a, b) of rows (mask, key, fp) sorted by bucket."""
    carry = None
    for batch in chain(batches, [None]):
        if batch is not None:
            part = [batch.column(i).to_numpy() for i in range(3)]
            carry = part if carry is None else [np.concatenate(x) for x in zip(carry, part)]
        if carry is None or not len(carry[0]):
            continue
        mask, key, fp = carry
        cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        done = len(fp) if batch is None else (int(cuts[-1]) if len(cuts) else 0)
        bounds = np.concatenate(([0], cuts[cuts < done], [done])) if done else np.zeros(1, np.int64)
        sizes, fp = np.diff(bounds), fp.view(np.uint64)
        pairs = bounds[:-1][sizes == 2]
        two = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= radius]
        links = [(fp[two], fp[two + 1])]
        for i, n in zip(bounds[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            links += joined(fp[i : i + n], radius)
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*links))
        carry = [x[done:] for x in carry]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(nodes: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between different fingerprints (fp, each once); what they connect is what all links within the radius connect."""
    spark = nodes.sparkSession
    open_, fixed, found = nodes.select(F.lit(0).cast("long").alias("mask"), "fp"), [0], None
    for turn in range(1, ROUNDS + 1):
        dealt = open_.join(F.broadcast(_tables(spark, radius, fixed)), "mask").select(F.explode("masks").alias("mask"), "fp")
        if found is not None:
            dealt = dealt.distinct()  # masks of several larger ones can be one
        dealt = dealt.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        sizes = dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        met = stored(dealt.join(sizes, ["mask", "key"]), "simhash-met")
        small = (met.where(F.col("n") <= bucket) if turn < ROUNDS else met).select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        here = small.mapInArrow(trimmed(lambda batches: _search(batches, radius)), "a long, b long")
        found = here if found is None else found.unionByName(here)
        open_ = met.where(F.col("n") > bucket).select("mask", "fp")
        if turn == ROUNDS or not open_.take(1):
            break
        fixed = sorted({m for f in fixed for m in covering(radius, f)})
    return found


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of docs."""
    rows = stored(fingerprints(docs, k), "simhash-rows")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "simhash-nodes")
    classes = components(links(nodes, radius, bucket))
    placed = stored(nodes.join(classes, nodes["fp"] == classes["id"], "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root")), "simhash-classes")
    of_class = stored(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes")), "simhash-ids")
    named = stored(with_fact(placed, of_class, "root", "nodes"), "simhash-named").select("fp", "copies", "component_id")
    found = with_fact(rows, named, "fp", "copies")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
