"""A Merkle manifest of documents: one tree of arity 8 a language, one over the languages, and an authentication path a row.

Leaves are hashed by column expressions, numbered in order within their language, and cut into aligned blocks of
8 to the power `DEPTH`. A block's root comes from a treehash stack; block roots are the leaves of the next round, until each
language has one root, and the languages' roots make the last tree. Then every block is traversed: for each level
a treehash stack takes one leaf a step from the run that comes next, so that when the leaf in turn enters that run its nodes
are ready. Besides its block's digests a traversal holds at most 15 nodes and one stack a level. The path above the block is the
same for all its leaves; it comes with the block and is appended.

A digest is SHA-256 in lowercase hexadecimal, of the concatenated texts of its inputs. A leaf digests doc_id, source, lang,
n_chars and text, each `-` if null and else its UTF-8 byte count, a colon and the value.

Defined results: leaves of a language go by (doc_id, digest), nulls first; rows equal in both are interchangeable, so they get
neighbouring places in any order. A null language is a language of its own, the first. A run of one node is hashed
like any other; a lone leaf is its language's root, a lone language's root the whole root. Tampering (lower-casing the text's A-Z
where 3 divides the unsigned crc32 of the decimal doc_id, of '' for null) leaves null texts and texts without capitals as
they are, so that those are verified. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from roadloom.llm.common import id_crc, shared_dir, stored, stored_at, trimmed

ARITY = 8
#: Levels of a block: 512 leaves.
DEPTH = 3

PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and shown: the leaf as a verifier finds it, after tampering; null where it is the leaf."""
    text = F.col("text").cast("string")
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    shown = F.when((F.pmod(id_crc(), F.lit(3)) == 0) & (lowered != text), leaf(lowered))
    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf(text).alias("leaf"), shown.alias("shown"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `at`, their place from 0 within their group, and `total`, their group's size.

    Rows are sorted by ranges of (group, order), a running number breaking ties, so that no group and no repeated row
    is one task; places come from the counts of each group in each range.
    """
    spark = rows.sparkSession
    tied = stored(rows.withColumn("tie", F.monotonically_increasing_id()), "merkle-rows")
    by = [group, *order, "tie"]
    ranged = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
    number = F.monotonically_increasing_id()
    placed = stored_at(ranged.select("*", F.spark_partition_id().alias("part"), number.alias("row")), shared_dir(spark, "merkle-order"))
    counts = placed.groupBy(F.col(group).alias("__g"), F.col("part").alias("__p")).agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__g", "__p", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start"), F.sum("n").over(Window.partitionBy("__g")).alias("total"))
    found = placed.join(starts, (F.col("part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")))
    return found.select(*rows.columns, (F.col("row") + F.col("start")).alias("at"), "total")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(total: int) -> int:
    """How often nodes become runs until one remains."""
    n = 0
    while total > 1:
        total, n = -(-total // ARITY), n + 1
    return n


class TreeHash:
    """Nodes of one level out of leaves that come one by one; it holds at most 7 nodes of each lower level."""

    def __init__(self, level: int):
        self.stack: list[list[str]] = [[] for _ in range(level)]

    def push(self, node: str) -> str | None:
        """The node that this leaf completes, if any."""
        for held in self.stack:
            held.append(node)
            if len(held) < ARITY:
                return None
            node = digest(*held)
            held.clear()
        return node

    def close(self) -> str | None:
        """The node over what is held when no more leaves come."""
        node = None
        for held in self.stack:
            if node is not None:
                held.append(node)
            node = digest(*held) if held else None
            held.clear()
        return node


def block_root(block: list[str], depth: int) -> str:
    tree, node = TreeHash(depth), None
    for x in block:
        node = tree.push(x)
    return node or tree.close()


def traverse(block: list[str], depth: int):
    """For each leaf in turn its path in the block: (nodes of the run, own place in it) a level."""
    runs: list[list[str]] = []
    for level in range(depth):
        tree, run = TreeHash(level), []
        for x in block[: ARITY ** (level + 1)]:
            if node := tree.push(x):
                run.append(node)
        if node := tree.close():
            run.append(node)
        runs.append(run)
    ahead = [TreeHash(level) for level in range(depth)]
    coming: list[list[str]] = [[] for _ in range(depth)]
    for i in range(len(block)):
        for level in range(depth):
            width = ARITY ** (level + 1)
            if i and i % width == 0:
                if node := ahead[level].close():
                    coming[level].append(node)
                runs[level], coming[level] = coming[level], []
            if i + width < len(block) and (node := ahead[level].push(block[i + width])):
                coming[level].append(node)
        yield [(runs[level], i // ARITY**level % ARITY) for level in range(depth)]


def _sides(path: list[tuple[list[str], int]]) -> list[tuple[str, str]]:
    return [("".join(run[:k]), "".join(run[k + 1 :])) for run, k in path]


def _blocks(batches, carried: list[str]):
    """(group, block, total, its upper row or None, its rows) of rows sorted by (group, block, upper first, at)."""
    now, upper, rows = None, None, []
    for batch in batches:
        head = zip(batch.column("g").to_pylist(), batch.column("block").to_pylist(), batch.column("total").to_pylist(), batch.column("upper").to_pylist())
        values = zip(*(batch.column(c).to_pylist() for c in carried))
        for (g, block, total, above), row in zip(head, values):
            if (g, block) != (now and now[:2]):
                if rows:
                    yield (*now, upper, rows)
                now, upper, rows = (g, block, total), None, []
            if above is not None:
                upper = above
            else:
                rows.append(row)
                now = (g, block, total)
    if rows:
        yield (*now, upper, rows)


def _tree(nodes: DataFrame, width: int) -> DataFrame:
    """g, at, path (to the group's root) and root of every node of (g, at, total, node); rounds as many as the tree has blocks of levels."""
    parts = nodes.withColumn("block", F.floor(F.col("at") / width)).withColumn("upper", F.lit(None).cast(f"struct<path:{PATH},root:string>"))
    sort = ["g", "block", F.asc_nulls_last("upper"), "at"]
    upper = _uppers(parts, width)

    def paths(batches):
        for g, _, total, above, rows in _blocks(batches, ["at", "node"]):
            path = traverse([r[1] for r in rows], min(levels(total), levels(width)))
            tail = [(s["left"], s["right"]) for s in above["path"]]
            found = [_sides(p) + tail for p in path]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), _path_array(found), pa.array([above["root"]] * len(rows), pa.string())],
                ["g", "at", "path", "root"],
            )

    return stored(parts.unionByName(upper.select("g", "total", "block", "upper"), allowMissingColumns=True).repartition("g", "block").sortWithinPartitions(*sort).mapInArrow(paths, f"g string, at long, path {PATH}, root string"), "merkle-paths")


def _path_array(found: list[list[tuple[str, str]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    return pa.array([[{"left": x, "right": y} for x, y in p] for p in found], kind)


def _uppers(parts: DataFrame, width: int) -> DataFrame:
    """g, block, total (of the group) and upper (the path above the block, and the group's root) of every block of (g, block, at, total, node)."""

    def roots(batches):
        for g, block, total, _, rows in _blocks(batches, ["node"]):
            root = block_root([r[0] for r in rows], min(levels(total), levels(width)))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((g, pa.string()), (block, pa.int64()), (total, pa.int64()), (root, pa.string()))], ["g", "block", "total", "root"])

    rows = parts.select("g", "block", "total", F.lit(None).cast("boolean").alias("upper"), "at", "node").repartition("g", "block").sortWithinPartitions("g", "block", "at")
    blocks = stored(rows.mapInArrow(trimmed(roots), "g string, block long, total long, root string"), "merkle-blocks")
    single = blocks.where(F.col("total") <= width).select("g", "block", "total", F.struct(F.expr(f"cast(array() as {PATH})").alias("path"), "root").alias("upper"))
    several = blocks.where(F.col("total") > width)
    if not several.take(1):
        return single
    above = _tree(several.select("g", F.col("block").alias("at"), F.ceil(F.col("total") / width).alias("total"), F.col("root").alias("node")), width)
    found = several.select("g", "block", "total").join(above.select(F.col("g").alias("__g"), "at", F.struct("path", "root").alias("upper")), F.col("g").eqNullSafe(F.col("__g")) & (F.col("block") == F.col("at")))
    return single.unionByName(found.select("g", "block", "total", "upper"))


def manifest(docs: DataFrame, depth: int = DEPTH, paths: bool = False) -> DataFrame:
    """doc_id, lang, at (place in the language), leaf, subroot, root, proof_sha256, folded_root and verified of every row; with `paths`, its path too."""
    width = ARITY**depth
    rows = stored(numbered(leaves(docs), "lang", ["doc_id", "leaf"]), "merkle-leaves")
    parts = rows.select(F.col("lang").alias("g"), F.floor(F.col("at") / width).alias("block"), "total", "at", "doc_id", "leaf", "shown")
    blocks = stored(_uppers(parts.withColumnRenamed("leaf", "node"), width), "merkle-uppers")

    # One tree over the languages; a language's root is that of any of its blocks.
    roots = blocks.where("block = 0").select("g", F.col("upper.root").alias("node"))
    langs = stored(numbered(roots.withColumn("one", F.lit("")), "one", ["g"]), "merkle-langs")
    over = _tree(langs.select(F.col("one").alias("g"), "at", "total", "node"), width)
    of_lang = langs.select(F.col("g").alias("__g"), "at").join(over.select("at", F.col("path").alias("lang_path"), F.col("root").alias("whole")), "at").drop("at")
    whole = F.struct(F.concat("upper.path", "lang_path").alias("path"), F.col("upper.root").alias("root"), F.col("whole").alias("whole"))
    upper = blocks.join(of_lang, F.col("g").eqNullSafe(F.col("__g"))).select("g", "block", "total", whole.alias("upper"))

    id_type = docs.schema["doc_id"].dataType.simpleString()
    id_arrow = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = f"doc_id {id_type}, lang string, at long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + f", path {PATH}" * paths
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def prove(batches):
        for g, _, total, above, held in _blocks(batches, ["doc_id", "at", "leaf", "shown"]):
            tail = [(s["left"], s["right"]) for s in above["path"]]
            out: list[list] = [[] for _ in names]
            for (doc_id, at, own, shown), path in zip(held, traverse([r[2] for r in held], min(levels(total), depth))):
                sides = _sides(path) + tail
                node = shown or own
                for left, right in sides:
                    node = digest(left, node, right)
                row = (doc_id, g, at, own, above["root"], above["whole"], digest(*(x for pair in sides for x in pair)), node, node == above["whole"])
                for column, value in zip(out, row):
                    column.append(value)
                if paths:
                    out[-1].append(sides)
            kinds = [id_arrow, pa.string(), pa.int64(), *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(out, kinds)), *([_path_array(out[-1])] if paths else [])], names)

    every = parts.unionByName(upper, allowMissingColumns=True)
    ordered = every.repartition("g", "block").sortWithinPartitions("g", "block", F.asc_nulls_last("upper"), "at")
    return ordered.mapInArrow(trimmed(prove), schema)
