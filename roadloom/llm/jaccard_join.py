"""N-gram Jaccard join by prefix trees, returning each document's class of linked documents.

Sets are distinct hashed word shingles in one global order: rare before frequent, by a fixed number of counters
over all documents (any order gives right results; this one keeps common passages out of
the short lists). Documents with the same set are one node. Steps:

1. Prefix lists: two sets of Jaccard t or more share one of their first n - ceil(t n) + 1 tokens.
   Tokens are sorted across the cluster; of a token only nodes that another is near enough in length to link with stay. For tokens of very
   many nodes that is told from counts by length, so that none of them is sorted in one task.
2. Home blocks: a node lives in the block of its least shared token. Blocks of too many nodes are split
   by hash; a few nodes of such a block are in each of its parts and tie these together.
   A block's sets form a prefix tree, read from the frequent end so that
   near copies share long paths. A probe walks the tree once, sharing the overlap counted so far, and leaves subtrees
   whose lengths cannot reach the needed overlap. Nodes found linked are joined, and a node already
   joined with the block's main class is not probed again: it has no cross-class link that another's probe misses.
3. Rest: where a token's nodes are still of several classes, they form a block of that token (of tokens with the same nodes only one);
   of a block in several parts, the nodes outside its largest class also probe the trees of the other parts.
   With steps 2 and 3 each pair that shares a leading token is either in one class or has been compared.
4. Links are joined to components with large-star and small-star rounds.

No pairs are emitted within a group, nothing is capped, and links and components stay distributed.
Shingles are compared as 56-bit hashes. A set is told by 128 bits: nodes are 64-bit hashes, and where a second hash shows two sets under one of them, the other gets a
node of its own.

Defined results: null, empty and wordless texts have 0 shingles and their own id; fewer words than a shingle are one
shingle. Rows without doc_id have no component_id and link to nothing by it. Rows that repeat a doc_id are one document of
several texts: all get the least id that any of them reaches. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import chunks, discard, shared_dir, stored, stored_at, text_or_empty, trimmed
from roadloom.llm.words import LOWER, NOT_SPACE, hashes, mix, ngrams, spans, whole

RANK_BITS = 20
_SLICES = 64
#: A block has about so many nodes and shingles at most.
BLOCK_NODES, BLOCK_SHINGLES = 2000, 400_000
_U = np.uint64


def _grams(buf: np.ndarray, offs: np.ndarray, k: int):
    """(row, hashes of its shingles, repeats included) of a run of rows."""
    low = LOWER[buf]
    starts, ends, first = spans(low, offs, NOT_SPACE)
    h = hashes(low, starts, ends)
    g = ngrams(h, k)
    for r in range(len(offs) - 1):
        a, b = int(first[r]), int(first[r + 1])
        yield r, (g[a : b - k + 1] if b - a >= k else whole(h[a:b]) if b > a else g[:0])


def _sets(buf: np.ndarray, offs: np.ndarray, k: int, levels: np.ndarray):
    """(row, ascending distinct tokens). A token is the level of its counter over 56 bits of its hash."""
    for r, g in _grams(buf, offs, k):
        g = np.unique((levels[g >> _U(64 - RANK_BITS)] << _U(56)) | (g >> _U(8)))
        yield r, g


def _node(tokens: np.ndarray) -> int:
    return int(mix(mix(tokens ^ _U(0x5DEECE66D)).sum(dtype=_U, keepdims=True) + _U(len(tokens))).view(np.int64)[0])


def _check(tokens: np.ndarray) -> int:
    """A second hash of a set."""
    return int(mix(mix(tokens + _U(0xA24BAED4963EE407)).sum(dtype=_U, keepdims=True) ^ _U(len(tokens) * 0x9FB21C651E98DF25 % (1 << 64))).view(np.int64)[0])


def levels(docs: DataFrame, k: int) -> np.ndarray:
    """For each counter the level (about 12 % apart) of how many distinct shingles of all documents fell on it."""
    size = (1 << RANK_BITS) // _SLICES

    def count(batches):
        total = np.zeros(1 << RANK_BITS, dtype=np.int64)
        for b in batches:
            for _, _, buf, offs in chunks(b.column(0)):
                seen = [np.unique(g) for _, g in _grams(buf, offs, k)]
                total += np.bincount((np.concatenate(seen) >> _U(64 - RANK_BITS)).astype(np.int64), minlength=1 << RANK_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SLICES)), pa.array([zlib.compress(total[i * size : (i + 1) * size].tobytes(), 1) for i in range(_SLICES)], pa.binary())], ["slice", "n"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = np.frombuffer(zlib.decompress(z), dtype=np.int64)
                sums[s] = sums[s] + n if s in sums else n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], ["slice", "n"])

    parts = docs.select(text_or_empty().alias("text")).mapInArrow(trimmed(count), "slice long, n binary").repartition(_SLICES, "slice").mapInArrow(trimmed(add), "slice long, n binary")
    total = np.zeros(1 << RANK_BITS, dtype=np.int64)
    for r in parts.collect():  # the fixed number of counters
        total[r["slice"] * size : (r["slice"] + 1) * size] += np.frombuffer(zlib.decompress(bytes(r["n"])), dtype=np.int64)
    return np.minimum(6 * np.log2(total + 1.0), 255).astype(_U)


class PrefixTree:
    """Trie of token sequences (descending), its chains of single children made one node."""

    __slots__ = ("sets", "comp", "start", "end", "of", "kids", "leaf", "low", "high", "one")

    def __init__(self, sets: list[np.ndarray], comp: list[int]):
        self.sets, self.comp = [s[::-1] for s in sets], comp
        self.start, self.end, self.of, self.kids, self.leaf = [0], [0], [-1], [[]], [-1]
        order = sorted(range(len(sets)), key=lambda i: (~self.sets[i]).astype(">u8").tobytes())
        stack, last = [0], None
        for i in order:
            a, shared = self.sets[i], 0
            if last is not None:
                b = self.sets[last]
                n = min(len(a), len(b))
                differ = np.flatnonzero(a[:n] != b[:n])
                shared = int(differ[0]) if len(differ) else n
            below = None
            while self.end[stack[-1]] > shared:
                below = stack.pop()
            if self.end[stack[-1]] < shared:  # the path forks inside the node last left
                fork = self._add(self.end[stack[-1]], shared, self.of[below])
                self.kids[stack[-1]][-1] = fork
                self.kids[fork].append(below)
                self.start[below] = shared
                stack.append(fork)
            own = self._add(shared, len(a), i)
            self.leaf[own] = i
            self.kids[stack[-1]].append(own)
            stack.append(own)
            last = i
        n = len(self.end)
        self.low, self.high, self.one = [1 << 60] * n, [0] * n, [None] * n
        self._bounds()

    def _add(self, start: int, end: int, of: int) -> int:
        for held, v in ((self.start, start), (self.end, end), (self.of, of), (self.kids, []), (self.leaf, -1)):
            held.append(v)
        return len(self.end) - 1

    def _bounds(self) -> None:
        """Shortest and longest set below each node, and their class where it is one."""
        todo = [(0, False)]
        while todo:
            v, done = todo.pop()
            if not done:
                todo.append((v, True))
                todo += [(k, False) for k in self.kids[v]]
                continue
            comps = set()
            if self.leaf[v] >= 0:
                self.low[v] = self.high[v] = self.end[v]
                comps.add(self.comp[self.leaf[v]])
            for k in self.kids[v]:
                self.low[v], self.high[v] = min(self.low[v], self.low[k]), max(self.high[v], self.high[k])
                comps.add(self.one[k])
            self.one[v] = comps.pop() if len(comps) == 1 else None

    def probe(self, x: np.ndarray, num: int, den: int, comp: int | None = None) -> list[int]:
        """Places of the sets that link with x (ascending tokens); subtrees all of class `comp` are left out."""
        found, nx, both = [], len(x), num + den
        todo = [(0, 0, nx)]  # node, overlap of the path, tokens of x still to come
        while todo:
            v, o, rest = todo.pop()
            if self.leaf[v] >= 0 and o * both >= num * (nx + self.end[v]):
                found.append(self.leaf[v])
            depth = self.end[v]
            for k in self.kids[v]:
                if comp is not None and self.one[k] == comp:
                    continue
                best = min(max(depth + rest, self.low[k]), self.high[k])  # the length that could fare best
                if (o + min(best - depth, rest)) * both < num * (nx + best):
                    continue
                seg = self.sets[self.of[k]][self.start[k] : self.end[k]]
                at = np.searchsorted(x, seg)
                hit = x[np.minimum(at, nx - 1)] == seg
                todo.append((k, o + int(np.count_nonzero(hit)), int(at[-1])))
        return found


def _block_links(tree: PrefixTree, sets: list[np.ndarray], num: int, den: int):
    """Links that join classes of a block. Of the largest class only the first set probes: a
    link of any other set is found by the set outside, and sets that have come into that class need no probe."""
    comps = tree.comp
    place = {c: i for i, c in enumerate(dict.fromkeys(comps))}
    names = list(place)
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sizes = Counter(comps)
    main = place[max(names, key=lambda c: (sizes[c], -place[c]))]
    first = comps.index(names[main])
    for i in [first, *range(len(comps))]:
        own = place[comps[i]]
        if i != first and root(own) == root(main) or len(names) == 1:
            continue
        for j in tree.probe(sets[i], num, den, comps[i]):
            x, y = root(own), root(place[comps[j]])
            if x != y:
                parent[max(x, y)] = min(x, y)
    for i in range(len(names)):
        if root(i) != i:
            yield names[root(i)], names[i]


def _packed(batches):
    """Texts of nodes, compressed: they are shuffled by block."""
    for b in batches:
        packed = [zlib.compress(t.as_py().encode("utf-8"), 6) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), *b.columns[2:]], b.schema.names)


def _unpacked(packed: pa.Array, k: int, levels: np.ndarray, rows: int = 256):
    """(row, tokens) of compressed texts."""
    for a in range(0, len(packed), rows):
        texts = pa.array([zlib.decompress(t.as_py()) for t in packed[a : a + rows]], pa.large_binary()).cast(pa.large_string())
        for i, _, buf, offs in chunks(texts):
            for r, tokens in _sets(buf, offs, k, levels):
                yield a + i + r, tokens


def _stream(batches, levels_of, k: int, flush):
    """Groups of rows (key, part, role, node, comp, text), sorted so that a group's rows follow each other; flush(role, nodes, comps, sets) yields links.

    Rows of role 0 are held until their group ends or its first row of role 1 comes; those of role 1 pass one by one.
    """
    held, out, seen, now = ([], [], []), [], set(), None
    state: dict = {}
    for b in batches:
        key, part, role, node, comp = (b.column(i).to_pylist() for i in range(5))
        for at, tokens in _unpacked(b.column(5), k, levels_of()):
            if (key[at], part[at]) != now:
                out += flush(state, held, None)
                held, seen, now, state = ([], [], []), set(), (key[at], part[at]), {}
            if (role[at] == 2, node[at]) in seen or (own := _node(tokens)) != node[at] and own ^ _check(tokens) != node[at]:
                continue  # a repeated row, or another text of the same id
            seen.add((role[at] == 2, node[at]))
            if role[at] < 2:
                for x, v in zip(held, (node[at], comp[at], tokens), strict=True):
                    x.append(v)
            else:
                out += flush(state, held, (comp[at], tokens))
        if len(out) > 5000:
            yield _links(out)
            out = []
    out += flush(state, held, None)
    yield _links(out)


def _links(pairs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """id, root (the least id reachable) of every id in links (a, b), by large-star and small-star rounds."""
    e = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
    before = mark(e)
    while before["n"]:
        sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        e = stored(large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small).distinct(), "stars")
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _shared(batches, num: int, den: int):
    """Of rows sorted by (token, n, leading first, node), each once: those that could link by their token. In the order of
    lengths, a node stays if a shorter leading one or, being leading, the next longer one is near enough in length."""
    names, carry, before = ["token", "node", "n"], None, 0
    for b in batches:
        t, v, n, lead = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if carry is not None:
            t, v, n, lead = (np.concatenate(([c], x)) for c, x in zip(carry, (t, v, n, lead), strict=True))
        if not len(t):
            continue
        new = np.ones(len(t), dtype=bool)
        new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
        t, v, n, lead = t[new], v[new], n[new], lead[new].astype(bool)
        at, same = np.arange(len(t)), t[1:] == t[:-1]
        begin = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), at, 0))
        leader = np.concatenate(([-1], np.maximum.accumulate(np.where(lead, at, -1))[:-1]))
        shorter = np.where(leader >= begin, n[leader], np.where(begin == 0, before, 0))
        keep = (shorter > 0) & (shorter * den >= n * num)
        keep[:-1] |= same & lead[:-1] & (n[:-1] * den >= n[1:] * num)
        carry, before = (t[-1], v[-1], n[-1], lead[-1]), int(shorter[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep[:-1]].astype("int64")) for x in (t, v, n)], names)
    if carry is not None and before and before * den >= carry[2] * num:
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in carry[:3]], names)


def _shared_often(tokens: DataFrame, num: int, den: int, folder: str) -> DataFrame:
    """What _shared gives, over a table of distinct nodes stored in `folder`, by counts: a token's nodes of one length fare alike, so that lengths are compared instead of nodes, and nodes are spread by their own hash."""
    each = stored_at(tokens.groupBy("token", "node").agg(F.max("n").alias("n"), F.max("leading").alias("leading")), folder)
    lengths = each.groupBy("token", "n").agg(F.count("*").alias("c"), F.count_if("leading").alias("l"))
    of = Window.partitionBy("token").orderBy("n")
    shorter = F.max(F.when(F.col("l") > 0, F.col("n"))).over(of.rowsBetween(Window.unboundedPreceding, -1))
    under = F.coalesce(shorter * den >= F.col("n") * num, F.lit(False))
    over = F.coalesce(F.col("n") * den >= F.lead("n").over(of) * num, F.lit(False))
    told = stored(lengths.select("token", "n", (under | over | (F.col("c") > 1)).alias("as_leading"), (under | (F.col("l") > 0)).alias("as_other")), "jaccard-often-lengths")
    return each.join(told, ["token", "n"]).where(F.when(F.col("leading"), F.col("as_leading")).otherwise(F.col("as_other"))).select("token", "node", "n")


def link_classes(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: den * intersection >= num * union links two documents."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(levels(docs, k))  # fixed number of counters

    def prefixes(batches):
        sent: set[tuple[int, int]] = set()
        for b in batches:
            for i, j, buf, offs in chunks(b.column(1)):
                size, node, check, prefix = [], [], [], []
                for _, x in _sets(buf, offs, k, held.value):
                    n = len(x)
                    size.append(n)
                    node.append(_node(x) if n else None)
                    check.append(_check(x) if n else None)
                    first = n and (node[-1], check[-1]) not in sent  # copies in a task send their prefix once
                    prefix.append(x[: n - -(-num * n // den) + 1].view(np.int64) if first else np.zeros(0, np.int64))
                    if first:
                        sent.add((node[-1], check[-1]))
                if len(sent) > 200_000:
                    sent.clear()
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(p) for p in prefix]))), pa.int32()), pa.array(np.concatenate(prefix), pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], *(pa.array(c, pa.int64()) for c in (size, node, check)), flat], ["doc_id", "n", "node", "check", "prefix"])

    full = shared_dir(spark, "jaccard-prefixes")
    rows = stored_at(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(trimmed(prefixes), "doc_id long, n long, node long, check long, prefix array<long>"), full)
    by_node = lambda df: stored(df.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("check").alias("check"), F.max("check").alias("other")), "jaccard-named")
    named = by_node(rows)
    if (clash := named.where("check <> other").select(F.col("node").alias("__node"), F.col("check").alias("__check"))).take(1):
        # Different sets of one hash: all but those of the least second hash are named anew.
        rows = rows.join(clash, F.col("node") == F.col("__node"), "left").withColumn("node", F.when(F.col("check") != F.col("__check"), F.col("node").bitwiseXOR(F.col("check"))).otherwise(F.col("node"))).drop("__node", "__check")
        named = by_node(rows)
    named = named.select("node", "doc_id")

    # If this is the first token that a linked pair has in common, the rest of either set must reach the overlap that
    # both lengths need; for the shorter set that leaves only a leading part of its prefix.
    tokens = rows.select(F.posexplode("prefix").alias("pos", "token"), "node", "n")
    tokens = tokens.select("token", "node", "n", ((F.col("n") - F.col("pos")) * (num + den) >= 2 * num * F.col("n")).alias("leading"))
    # Tokens that many nodes have are not sorted in one task each. A token's level bounds how often its counter was met, so only few need to be counted.
    hot = max(BLOCK_NODES, rows.count() // 1024)
    often = tokens.where(F.shiftrightunsigned("token", 56) >= int(6 * np.log2(hot + 1.0))).groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("token")
    often = stored(often, "jaccard-often")  # each is in over a 1024th of the prefixes, so they are few
    near = tokens.join(F.broadcast(often), "token", "left_anti").repartition("token").sortWithinPartitions("token", "n", F.desc("leading"), "node")
    near = near.mapInArrow(trimmed(lambda batches: _shared(batches, num, den)), "token long, node long, n long")
    each = shared_dir(spark, "jaccard-often-nodes")
    if often.take(1):
        near = near.unionByName(_shared_often(tokens.join(F.broadcast(often), "token", "left_semi"), num, den, each))
    shared = stored(near, "jaccard-shared")
    discard(spark, each)
    # The prefixes, most of what is stored, have served: only the rows' other columns stay.
    rows = stored(rows.select("doc_id", "n", "node"), "jaccard-rows")
    discard(spark, full)

    # Home blocks, and the centres that the parts of a split block have in common.
    home = shared.groupBy("node").agg(F.min("token").alias("key"), F.max("n").alias("n"))
    by_key = home.groupBy("key").agg(
        F.greatest(F.ceil(F.count("*") / F.lit(float(BLOCK_NODES))), F.ceil(F.sum("n") / F.lit(float(BLOCK_SHINGLES)))).cast("int").alias("parts"),
        *[F.min_by("node", F.xxhash64("node", F.lit(s))).alias(f"c{s}") for s in range(4)],
    )
    centre = (F.col("parts") > 1) & F.col("node").isin(*[F.col(f"c{s}") for s in range(4)])
    placed = stored(home.join(by_key, "key").select("node", "key", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.when(centre, F.col("parts")).alias("ties")), "jaccard-homes")

    # One text for each node that shares a token; it brings its places along, so that it moves to its block at once.
    wanted = placed.join(named, "node")
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(wanted, "doc_id").select("node", "text", "key", "part", "ties")
    texts = stored(packed.mapInArrow(trimmed(_packed), "node long, text binary, key long, part int, ties int"), "jaccard-texts")

    def place(part, role):
        return F.struct(part.alias("part"), F.lit(role).alias("role"))

    ties = F.when(F.col("ties").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("ties") - 1), lambda p: place(p, 0)))
    places = F.concat(F.array(place(F.col("part"), 1)), F.coalesce(ties, F.expr("cast(array() as array<struct<part:int,role:int>>)")))
    grouped = texts.select("key", F.explode(places).alias("p"), "node", "text").select("key", "p.part", "p.role", "node", F.col("node").alias("comp"), "text")

    def compare(batches):
        def flush(state, block, probe):
            links = []
            if "tree" not in state and len(block[0]) > (probe is None):
                state["tree"] = PrefixTree(block[2], block[1])
                links += _block_links(state["tree"], block[2], num, den)
            if probe is not None and "tree" in state:
                links += [(probe[0], c) for c in sorted({block[1][i] for i in state["tree"].probe(probe[1], num, den, probe[0])}) if c != probe[0]]
            return links

        yield from _stream(batches, lambda: held.value, k, flush)

    order = ["key", "part", "role", "node"]
    first_links = stored(grouped.repartition("key", "part").sortWithinPartitions(*order).mapInArrow(trimmed(compare), "a long, b long"), "jaccard-links")
    classes = components(first_links)

    # Tokens whose nodes are still of several classes, one of those that have the same nodes.
    info = stored(placed.join(classes, placed["node"] == classes["id"], "left").select("node", F.coalesce("root", "node").alias("comp")), "jaccard-classes")
    seen = shared.join(info, "node").select("token", "node", "n", "comp")
    # Stored, so that the next join has plain shuffles on both sides, and a token of many nodes can be split.
    mixed = stored(seen.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token"), "jaccard-mixed")
    seen = stored(seen.join(mixed, "token", "left_semi"), "jaccard-seen")
    by_class = seen.groupBy("token", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("n"), *[F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)])
    many = by_class.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1"))
    parts = F.greatest(F.ceil(F.col("c") / float(BLOCK_NODES)), F.ceil(F.col("n") / float(BLOCK_SHINGLES))).cast("int")
    groups = stored(many.where("comps > 1").groupBy("x0", "x1", "c").agg(F.min_by(F.struct("token", "main", parts.alias("parts")), "token").alias("g")).select("g.*"), "jaccard-groups")
    members = seen.join(groups, "token").select(F.col("token").alias("key"), F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node", "comp", "main", "parts")
    probes = members.where("parts > 1 and comp <> main").select("key", F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("part"))).alias("part"), F.lit(2).alias("role"), "node", "comp")
    rest = members.select("key", "part", F.lit(1).alias("role"), "node", "comp").union(probes).join(texts.select("node", "text"), "node").select("key", "part", "role", "node", "comp", "text")

    links = rest.repartition("key", "part").sortWithinPartitions(*order).mapInArrow(trimmed(compare), "a long, b long")

    # Rows that repeat an id tie their nodes.
    of_node = stored(named.join(info, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp")), "jaccard-nodes")
    several = rows.where("doc_id is not null and node is not null").groupBy("doc_id").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("doc_id", "least")
    ties = rows.select("doc_id", "node").join(several, "doc_id").select("least", "node").where("least <> node")
    ties = ties.join(of_node.select(F.col("node").alias("least"), F.col("comp").alias("a")), "least").join(of_node.select("node", F.col("comp").alias("b")), "node").select("a", "b")
    more = components(links.union(ties))

    # From nodes to documents.
    least = of_node.join(more, of_node["comp"] == more["id"], "left").select("node", F.coalesce("root", "comp").alias("comp"), "doc_id")
    of_comp = least.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    found = least.join(of_comp, "comp").select(F.col("node").alias("__node"), "component_id")
    out = rows.join(found, rows["node"] == found["__node"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def representatives(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One document of each class stays (the least doc_id), with the columns of docs; rows without an id stay."""
    gone = link_classes(docs, k, num, den).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
