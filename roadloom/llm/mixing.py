"""Mixing sources to target weights along a curriculum whose weights vary in time.

Targets: the sources, in code-point order with null last, weigh 3, 1, 2 and so on repeating, and share
`budget` times all words. A source gives at most `most_repeats` times its words; what is over goes to the others
by weight until none is above (the level of a water filling, found from running sums, not by rounds).

Curriculum: at time t in 0..1 a source's weight is tilt-shaped, 1 + a * (2t - 1), with a of a source set by its
place (rising, level, falling). Its integral gives the cumulative demand D(t) = target * (t + a * (t*t - t)). A source's
documents follow one another in an order by hash, pass after pass; the word at which
a document starts, put through the inverse of D, is its training position. Taking stops where the demand
is met: the document at the boundary gives only the words still wanted. Documents range-sorted
by position are the training order: `schedule` gives each once, `training_order` once for every pass.

Running sums are over cells of a source (by the leading digits of the hash, an MD5 of id and size), whose number grows with the rows, so a source with any share
of the rows is never one group. Only DataFrame functions are used.

Defined results: null and wordless texts have size 0, take nothing and have no position; sources of 0 words have
target 0; equal ids and texts follow one another. An empty table gives an empty table. Columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import append, text_or_empty

RESULTS = ["size", "source_size", "target", "taken", "passes"]
#: A source's documents are dealt into 16^d cells: d is 3 at least, and so large that a cell has about so many rows at most.
CELL_ROWS = 20_000


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most_repeats: float = 2.0, tilt: float = 0.5) -> DataFrame:
    """source, source_size -> also place, tilt, target. One row a source, whatever their documents."""
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = len(weights)
    listed = sizes.withColumn("place", F.row_number().over(ordered) - 1)
    listed = listed.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % n).cast("int")))
    listed = listed.withColumn("tilt", F.lit(tilt) * (1 - F.col("place") % 3)).withColumn("cap", F.col("source_size") * most_repeats)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "place")
    every = Window.partitionBy()
    # Sources fill up in the order of cap / weight: with those before it full, the level that the rest would reach.
    full = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    listed = listed.withColumn("level", (F.sum("source_size").over(every) * budget - full) / rest)
    stays_below = F.col("level") * F.col("w") <= F.col("cap")
    listed = listed.withColumn("level", F.min(F.when(stays_below, F.struct(F.col("cap") / F.col("w"), F.col("place"), F.col("level")))).over(every)["level"])
    target = F.least(F.coalesce(F.col("level") * F.col("w"), F.col("cap")), F.col("cap"))
    return listed.select("source", "source_size", "place", "tilt", target.alias("target"))


def position(start: Column, target: Column, tilt: Column) -> Column:
    """The time at which cumulative demand reaches `start` words: the root of a t^2 + (1 - a) t - start / target."""
    share, rest = F.try_divide(start, target), 1 - tilt
    return F.when(tilt == 0, share).otherwise((F.sqrt(rest * rest + 4 * tilt * share) - rest) / (2 * tilt))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most_repeats: float = 2.0, tilt: float = 0.5, seed: int = 8) -> DataFrame:
    """docs with size, source_size, target, taken and passes (array of pass, position, words)."""
    digits, n = 3, docs.count()
    while n > CELL_ROWS << 4 * digits:
        digits += 1
    # `__s` keeps null apart from every text, so that it joins as a value.
    rows = docs.withColumns({"__size": words(F.col("text")), "__s": F.concat(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce(F.col("source").cast("string"), F.lit("")))})
    # A missing id is stood for by the text, so that rows without one are spread too.
    named = F.coalesce(F.col("doc_id").cast("string"), F.md5(text_or_empty()))
    rows = rows.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}|"), named, F.lit("|"), F.col("__size").cast("string"))))
    # All that order needs is made here, so that no text moves for it.
    rows = rows.withColumns({"__cell": F.substring("__h", 1, digits), "__tie": F.xxhash64(text_or_empty())})
    cells = rows.groupBy("__s", "__cell").agg(F.sum("__size").alias("n"))
    sizes = cells.groupBy("__s").agg(F.sum("n").alias("source_size")).select(F.when(F.col("__s") != "n", F.substring("__s", 2, 1 << 30)).alias("source"), "__s", "source_size")
    goals = targets(sizes.select("source", "source_size"), weights, budget, most_repeats, tilt).withColumn("__s", F.concat(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce("source", F.lit(""))))
    before = Window.partitionBy("__s").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("__from", F.coalesce(F.sum("n").over(before), F.lit(0))).join(goals.select("__s", "source_size", "target", "tilt"), "__s")
    starts = starts.select(F.col("__s").alias("__s2"), F.col("__cell").alias("__c2"), "__from", F.col("source_size").alias("__total"), F.col("target").alias("__target"), F.col("tilt").alias("__tilt"))

    in_cell = Window.partitionBy("__s", "__cell").orderBy("__h", "doc_id", "__size", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.join(starts, (F.col("__s") == F.col("__s2")) & (F.col("__cell") == F.col("__c2")))
    held = held.withColumn("__start", F.col("__from") + F.coalesce(F.sum("__size").over(in_cell), F.lit(0)))

    most = int(-(-most_repeats // 1))
    goal = F.floor(F.col("__target") + 0.5)

    def one(k: int) -> Column:
        start = F.col("__start") + k * F.col("__total")
        took = F.greatest(F.least(F.col("__size"), goal - start), F.lit(0).cast("long"))
        return F.struct(F.lit(k).alias("pass"), position(start, F.col("__target"), F.col("__tilt")).alias("position"), took.alias("words"))

    passes = F.filter(F.array(*[one(k) for k in range(most)]), lambda p: p["words"] > 0)
    taken = F.aggregate(passes, F.lit(0).cast("long"), lambda acc, p: acc + p["words"])
    done = append(held, F.col("__size"), F.col("__total"), F.col("__target"), taken, passes, names=RESULTS)
    return done.drop("__h", "__cell", "__tie", "__size", "__s", "__s2", "__c2", "__from", "__total", "__target", "__tilt", "__start")


def training_order(docs: DataFrame, partitions: int | None = None, **options) -> DataFrame:
    """The documents in training order, with the columns of docs: one row for each pass that takes from a
    document, range-sorted by position. Documents stay whole: that at a source's boundary comes whole too."""
    renamed = {c: f"__kept_{c}" for c in docs.columns if c.lower() in RESULTS}
    mixed = mix(docs.withColumns({v: docs[f"`{c}`"] for c, v in renamed.items()}), **options)
    cols = [F.col(f"`{renamed[c]}`").alias(c) if c in renamed else F.col(f"`{c}`") for c in docs.columns]
    each = mixed.select(*cols, F.explode("passes").alias("__p")).withColumns({"__pos": F.col("__p.position"), "__pass": F.col("__p.pass")})
    return by_position(each, "__pos", "doc_id", "__pass", partitions=partitions).select(*docs.columns)


def by_position(rows: DataFrame, *order: str, partitions: int | None = None) -> DataFrame:
    """Rows range-sorted by position and what tells those of one position apart; rows without a position come last."""
    by = [F.asc_nulls_last(c) for c in order]
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *by).sortWithinPartitions(*by)


def schedule(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and position of every document in training order: range-sorted by the position of its first pass, what nothing is taken of last."""
    mixed = mix(docs, **options).select("doc_id", "size", "source_size", "target", "taken", F.get("passes", F.lit(0))["position"].alias("position"))
    return by_position(mixed, "position", "doc_id", "size")
