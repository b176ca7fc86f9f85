"""Exact deduplication over an extendible-hash index in shared files.

1. One pass normalises and hashes every text and stores the rows with hash, digest and normalised text.
2. Rows become links (hash, digest, count, least id): copies meet on the map side, so a huge group is one row a task.
3. The directory: buckets are leading bits of the hash. A bucket of more than `bucket_entries` different hashes (chains) is split
   along its next bit, its siblings are not, so each has its own local depth; the directory has 2^(greatest local depth) slots, each
   naming a bucket, and is stored. Past 2^14 times `bucket_entries` chains the capacity grows with their number, so the directory keeps to
   a bounded size and is broadcast. A bucket that is overfull at the last depth (no run of real hashes is) stays one bucket, which spills.
4. Owners: the buckets in key order are dealt to tasks in ranges of near equal length. Each owner sorts its links by
   bucket and hash, chains those of one hash, and writes one index file.
5. Comparing bytes: a chain of one row is settled. Other chains' texts go to the owner of their bucket and are grouped
   there by (bucket, hash, text). Texts of links that hold a thousandth of all rows or more (a thousand such at most) meet on the map side before they move.
   Which chains have more than one row is broadcast up to MARKS of them, counted before; beyond that all texts go to their owners.
6. Every stored row takes its link's answer: those of the large links by broadcast, the others by a join in which no key is large.

Only DataFrame functions are used. Defined results: null text counts as empty; a null id sorts after all
others (a group of null ids keeps a null id); rows that repeat the smallest id with the same text are
all marked kept, as nothing tells them apart. An empty table gives an empty table. Extra columns stay; those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import append, stored

RESULTS = ["keep_id", "group_size", "kept", "text_sha256"]
#: The finest directory has 2^MOST_DEPTH slots; buckets hold so large a part of all chains at least that about 2^SPREAD suffice.
MOST_DEPTH, SPREAD = 20, 14
#: Chains to compare that are broadcast as marks (8 bytes each); links with this part of all rows are large.
MARKS, LARGE = 2_000_000, 1024


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def slot(h: Column, depth: int) -> Column:
    """Directory slot: the top `depth` bits of the hash."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def buckets(chains: DataFrame, bucket_entries: int) -> DataFrame:
    """depth, prefix, n of each bucket that is not empty; chains: distinct h."""
    fine = stored(chains.groupBy(slot(F.col("h"), MOST_DEPTH).alias("s")).agg(F.count("*").alias("n")), "exact-fine")
    total = fine.agg(F.sum("n")).first()[0] or 0
    most = max(bucket_entries, total >> SPREAD)
    each = F.transform(F.sequence(F.lit(0), F.lit(MOST_DEPTH)), lambda d: F.struct(d.alias("depth"), F.call_function("shiftright", "s", F.lit(MOST_DEPTH) - d).alias("prefix")))
    level = fine.select("n", F.explode(each).alias("x")).groupBy("x.depth", "x.prefix").agg(F.sum("n").alias("n"))
    level = stored(level, "exact-levels")
    split = level.where(F.col("n") > most).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    held = level.withColumn("parent", F.shiftright("prefix", 1))
    whole = (F.col("n") <= most) | (F.col("depth") == MOST_DEPTH)
    return held.where(whole & (F.col("depth") > 0)).join(split, ["depth", "parent"], "left_semi").drop("parent").unionByName(level.where(whole & (F.col("depth") == 0)))


def directory(chains: DataFrame, bucket_entries: int, owners: int) -> tuple[DataFrame, int]:
    """(slot, depth, bucket, owner) for every slot of a bucket that is not empty, and the directory's depth."""
    found = stored(buckets(chains, bucket_entries), "exact-buckets")
    depth = found.agg(F.max("depth")).first()[0] or 0
    first = F.call_function("shiftleft", "prefix", F.lit(depth) - F.col("depth"))
    span = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(depth) - F.col("depth"))
    # One row a bucket: their number is bounded whatever the corpus.
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    owner = F.floor(before * owners / F.sum("n").over(Window.partitionBy())).cast("int")
    dealt = found.withColumn("bucket", first).withColumn("owner", owner)
    slots = dealt.select(F.explode(F.sequence("bucket", F.col("bucket") + span - 1)).alias("slot"), "depth", "bucket", "owner")
    return stored(slots, "exact-directory"), depth


def index(links: DataFrame, slots: DataFrame, depth: int, owners: int) -> DataFrame:
    """The index files, one an owner: links (h, sha, keep, n) in order of bucket and hash, with how many rows their chain has."""
    placed = _owned(links, slots, depth).repartitionById(owners, "owner")
    chained = placed.withColumn("chain", F.sum("n").over(Window.partitionBy("owner", "bucket", "h")))
    return stored(chained.sortWithinPartitions("owner", "bucket", "h"), "exact-index")


def _owned(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    return rows.join(F.broadcast(slots.select(F.col("slot").alias("__slot"), "bucket", "owner")), slot(F.col("h"), depth) == F.col("__slot")).drop("__slot")


def deduplicate(docs: DataFrame, bucket_entries: int = 50_000, owners: int | None = None) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256."""
    owners = owners or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    norm = docs.withColumn("__norm", normalised(F.col("text")))
    rows = norm.withColumns({"__h": F.xxhash64("__norm"), "__sha": F.unhex(F.sha2(F.encode("__norm", "utf-8"), 256))})
    # The normalised text is stored where it is not the text itself.
    rows = stored(rows.withColumn("__norm", F.when(F.col("text").isNull() | (F.col("text").cast("string") != F.col("__norm")), F.col("__norm"))), "exact-rows")

    links = stored(rows.groupBy(F.col("__h").alias("h"), F.col("__sha").alias("sha")).agg(F.min("doc_id").alias("keep"), F.count("*").alias("n")), "exact-links")
    slots, depth = directory(links.select("h").distinct(), bucket_entries, owners)
    entries = index(links, slots, depth, owners)

    marks = entries.where("chain > 1").select("h").distinct()
    counted = entries.agg(F.sum("n").alias("rows"), F.count_if(F.col("chain") > 1).alias("links")).first()
    large = entries.where(F.col("n") * LARGE >= (counted["rows"] or 0)).where("n > 1").select(F.col("h").alias("__lh"), F.col("sha").alias("__ls"))
    is_large = (F.col("__h") == F.col("__lh")) & (F.col("__sha") == F.col("__ls"))

    texts = rows.select("__h", "__sha", F.coalesce("__norm", F.col("text").cast("string")).alias("norm"), F.col("doc_id").alias("keep"), F.lit(1).cast("long").alias("n"))
    met = texts.join(F.broadcast(large), is_large, "left_semi").groupBy("__h", "__sha", "norm").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
    others = texts.join(F.broadcast(large), is_large, "left_anti")
    if counted["links"] <= MARKS:
        others = others.join(F.broadcast(marks), F.col("__h") == F.col("h"), "left_semi")
    moved = _owned(met.unionByName(others).withColumnsRenamed({"__h": "h", "__sha": "sha"}), slots, depth).repartitionById(owners, "owner")
    compared = moved.groupBy("owner", "bucket", "h", "norm").agg(F.first("sha").alias("sha"), F.min("keep").alias("keep"), F.sum("n").alias("n"))
    answers = stored(compared.where("n > 1").select(F.col("h").alias("__ah"), F.col("sha").alias("__as"), F.col("keep").alias("__keep"), F.col("n").alias("__n")), "exact-answers")

    by_link = (F.col("__h") == F.col("__ah")) & (F.col("__sha") == F.col("__as"))
    few = answers.join(F.broadcast(large), (F.col("__ah") == F.col("__lh")) & (F.col("__as") == F.col("__ls")), "left_semi")
    held = rows.drop("__norm")
    held = held.join(F.broadcast(few), by_link).unionByName(held.join(F.broadcast(large), is_large, "left_anti").join(answers, by_link, "left"))
    keep = F.when(F.col("__n").isNull(), F.col("doc_id")).otherwise(F.col("__keep"))
    done = append(held, keep, F.coalesce("__n", F.lit(1).cast("long")), F.col("doc_id").eqNullSafe(keep), F.lower(F.hex("__sha")), names=RESULTS)
    return done.drop("__h", "__sha", "__ah", "__as", "__keep", "__n")
