"""Benchmark decontamination with suffix arrays over the training texts.

Each shard of the corpus (a run of rows) is one array of word ids, and its suffix array is a sorted array of offsets into it.
Every window of every benchmark item is binary-searched in it, comparing ids in place; the range of suffixes that start with the window gives all places
where it occurs. Of an item found in a document, the longest verbatim match and its places follow from
the ids of both by doubling. No suffix is ever copied out: a shard's arrays take about 60 bytes a word whatever the length of texts and items.
A shard keeps only suffixes that a window could start at: those followed, within their
document, by enough words that the benchmark has at all. No match can start anywhere else.

Words are equal when their bytes are: words are found by 64-bit hash and then compared with
the benchmark's own bytes; benchmark words of one hash are told apart by them too.

Benchmark items are read to the driver and broadcast in blocks of at most `block_bytes` of text (an item is never split). With more
than one block the corpus is stored and passes each in turn; a block's finds are stored, and its broadcast is destroyed, before the next block
is loaded, so memory and plans are those of one block for any benchmark.

Defined results: a null or wordless text has no words, no hits and is not contaminated; a null or wordless item
has no window; a null item_id counts as empty text in the list of items; items that repeat an item_id
are listed once. An item of fewer than `window` words is one window. Of longest matches that are equally long the first in the item, then in
the document, is given. Columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import append, append_struct, chunks, stored, text_or_empty, trim
from roadloom.llm.words import ALNUM, LOWER, hashes, spans

RESULTS = ["n_words", "n_hit", "items", "longest", "contaminated"]
_FOUND = "n_words long, hits array<struct<start:long,length:long>>, items array<string>, longest array<struct<item:string,item_word:long,word:long,length:long>>"


@dataclass(frozen=True)
class Items:
    """A block of benchmark items as one array of word ids, ready to be searched for."""

    vocabulary: np.ndarray  # sorted hashes
    word: np.ndarray  # the id of each
    alike: dict[int, list[int]]  # ids by id, of further words with the same hash
    letters: np.ndarray  # bytes of the words, by id
    at: np.ndarray  # and where each begins
    ids: np.ndarray  # of all items
    names: list[str]
    first: np.ndarray  # where each item begins in ids
    starts: np.ndarray  # of windows, in ids
    widths: np.ndarray
    item: np.ndarray  # of each window

    @property
    def least(self) -> int:
        return int(self.widths.min()) if len(self.widths) else 0


def items_of(block: list[tuple[str, str]], window: int) -> Items:
    by_word: dict[bytes, int] = {}
    by_hash: dict[int, list[int]] = {}
    ids, names, first = [], [], [0]
    for name, text in block:
        buf = LOWER[np.frombuffer(text.encode("utf-8"), dtype=np.uint8)]
        starts, ends, _ = spans(buf, np.array([0, len(buf)]), ALNUM)
        raw, own = buf.tobytes(), np.empty(len(starts), np.int32)
        for k, (a, b, h) in enumerate(zip(starts.tolist(), ends.tolist(), hashes(buf, starts, ends).tolist(), strict=True)):
            found = by_word.get(raw[a:b])
            if found is None:
                found = by_word[raw[a:b]] = len(by_word) + 1
                by_hash.setdefault(h, []).append(found)
            own[k] = found
        ids.append(own)
        names.append(name)
        first.append(first[-1] + len(own))
    vocabulary = np.array(sorted(by_hash), dtype=np.uint64)
    first = np.array(first)
    n = np.diff(first)
    windows = np.where(n > 0, np.maximum(n - window, 0) + 1, 0)
    item = np.repeat(np.arange(len(n)), windows)
    begins = np.concatenate(([0], np.cumsum(windows)))[:-1] if len(n) else windows
    return Items(
        vocabulary,
        np.array([by_hash[h][0] for h in vocabulary.tolist()], dtype=np.int32),
        {v[0]: v[1:] for v in by_hash.values() if len(v) > 1},
        np.frombuffer(b"".join(by_word), dtype=np.uint8),
        np.concatenate(([0, 0], np.cumsum([len(w) for w in by_word]))).astype(np.int64),  # id 0 is no word
        np.concatenate(ids) if ids else np.zeros(0, np.int32),
        names,
        first,
        first[item] + np.arange(len(item)) - begins[item],
        np.minimum(window, n)[item],
        item,
    )


def _spelled(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, s: Items) -> np.ndarray:
    """Whether the words of buf have the bytes of the words `ids`."""
    good = sizes == s.at[ids + 1] - s.at[ids]
    left, k = np.flatnonzero(good), 0
    while len(left):
        same = buf[starts[left] + k] == s.letters[s.at[ids[left]] + k]
        good[left[~same]] = False
        k += 1
        left = left[same]
        left = left[sizes[left] > k]
    return good


def _pairs(names: np.ndarray, left: np.ndarray, size: int) -> np.ndarray:
    """Names of blocks twice as long: ranks of (name, name `size` further on; 0 where the run ends before). left: how many words follow in the run."""
    further = np.zeros(len(names), np.int64)
    reach = np.flatnonzero(left > size)
    further[reach] = names[reach + size]
    return np.unique(names * (int(further.max(initial=0)) + 1) + further, return_inverse=True)[1].reshape(-1).astype(np.int64) + 1


class Shard:
    """Word ids of a run of rows, and the suffix array of those suffixes that a window could start at."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, s: Items):
        low = LOWER[buf]
        starts, ends, self.first = spans(low, offs, ALNUM)
        self.ids = np.zeros(len(starts), np.int32)
        self.at = self.run = np.zeros(0, np.int64)
        if not len(starts) or not len(s.vocabulary):
            return
        h = hashes(low, starts, ends)
        place = np.minimum(np.searchsorted(s.vocabulary, h), len(s.vocabulary) - 1)
        self.ids = np.where(s.vocabulary[place] == h, s.word[place], 0)
        self.run = self._runs()
        covered = self._covered(s.least)
        if not len(covered):
            return
        sizes, own = ends - starts, self.ids[covered]
        wrong = covered[~_spelled(low, starts[covered], sizes[covered], own, s)]
        for w in wrong.tolist():  # other words of the same hash
            more = np.array([x for x in s.alike.get(int(self.ids[w]), []) if _spelled(low, starts[[w]], sizes[[w]], np.array([x]), s)[0]], np.int32)
            self.ids[w] = more[0] if len(more) else 0
        if len(wrong):
            self.run = self._runs()
            covered = self._covered(s.least)
        # Suffixes sorted by doubling, as far as windows reach.
        names, left, size = self.ids[covered].astype(np.int64), self.run[covered], 1
        while size < int(s.widths.max()):
            names, size = _pairs(names, left, size), 2 * size
        live = np.flatnonzero(left >= s.least)
        self.at = covered[live[np.argsort(names[live], kind="stable")]]

    def _runs(self) -> np.ndarray:
        """For each word, how many words with an id follow without a gap in its row, itself included."""
        stop = np.flatnonzero(self.ids == 0)
        here = np.arange(len(self.ids))
        gap = np.append(stop, len(self.ids))[np.searchsorted(stop, here)]
        return np.minimum(gap, np.repeat(self.first[1:], np.diff(self.first))) - here

    def _covered(self, least: int) -> np.ndarray:
        """Words of the runs that are long enough for a window."""
        begins = np.flatnonzero((self.run > 0) & (np.concatenate(([0], self.run[:-1])) <= 1))
        long = begins[self.run[begins] >= least]
        mark = np.zeros(len(self.ids) + 1, np.int64)
        mark[long] += 1
        np.add.at(mark, long + self.run[long], -1)
        return np.flatnonzero(np.cumsum(mark[:-1]) > 0)

    def _bound(self, s: Items, starts: np.ndarray, widths: np.ndarray, after: bool) -> np.ndarray:
        """Where each window would go in the suffix array: before the suffixes that begin with it, or after them."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.at))
        todo = np.arange(len(starts)) if len(self.at) else np.zeros(0, np.int64)
        while len(todo):
            middle = (low[todo] + high[todo]) >> 1
            place = self.at[middle]
            up = np.full(len(todo), after)  # where all words are equal
            open_, k = np.arange(len(todo)), 0
            while len(open_):
                want, p = s.ids[starts[todo[open_]] + k], place[open_]
                inside = self.run[p] > k
                have = np.where(inside, self.ids[np.where(inside, p + k, 0)], 0)
                up[open_[have < want]] = True
                up[open_[have > want]] = False
                k += 1
                open_ = open_[have == want]
                open_ = open_[widths[todo[open_]] > k]
            low[todo[up]] = middle[up] + 1
            high[todo[~up]] = middle[~up]
            todo = todo[low[todo] < high[todo]]
        return low

    def search(self, s: Items) -> Iterator[tuple[int, int, np.ndarray]]:
        """(item, words of its windows, sorted first words of all their occurrences) of each item that occurs."""
        if not len(self.at):
            return
        present = np.zeros(len(s.at), bool)
        present[self.ids] = True
        there = np.concatenate(([0], np.cumsum(present[s.ids])))
        some = np.flatnonzero(there[s.starts + s.widths] - there[s.starts] == s.widths)
        low = self._bound(s, s.starts[some], s.widths[some], False)
        high = self._bound(s, s.starts[some], s.widths[some], True)
        found = np.flatnonzero(low < high)
        # Equal windows of an item have one range; the ranges of others are disjoint.
        _, once = np.unique(np.stack((s.item[some[found]], low[found])), axis=1, return_index=True)
        found = found[once]
        owner = s.item[some[found]]
        for i in np.unique(owner).tolist():
            of = found[owner == i]
            yield i, int(s.widths[some[of[0]]]), np.sort(np.concatenate([self.at[a:b] for a, b in zip(low[of], high[of], strict=True)]))


def longest_common(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """(length, first place in y, first place in x) of the longest block of words that both have; ids above 0, other words of x 0."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    z = np.concatenate((np.where(x > 0, x, -1 - np.arange(len(x))), y))
    _, z = np.unique(z, return_inverse=True)
    names, n = z.reshape(-1).astype(np.int64) + 1, len(x)
    left = np.concatenate((np.arange(n, 0, -1), np.arange(len(y), 0, -1)))

    def common(names: np.ndarray, size: int) -> np.ndarray:
        whole = left >= size
        return np.intersect1d(names[:n][whole[:n]], names[n:][whole[n:]])

    if not len(common(names, 1)):
        return 0, 0, 0
    size = 1
    while len(common(double := _pairs(names, left, size), 2 * size)):
        names, size = double, 2 * size

    def blocks(length: int) -> np.ndarray:
        """Names of blocks of size..2 * size words: of the two that overlap in them."""
        return _pairs(names, np.where(left >= length, left, 0), length - size) if length > size else names

    low, high = size, 2 * size
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if len(common(blocks(middle), middle)) else (low, middle)
    names = blocks(low)
    both = common(names, low)
    whole = left >= low
    in_y = int(np.flatnonzero(np.isin(names[n:], both) & whole[n:])[0])
    return low, in_y, int(np.flatnonzero((names[:n] == names[n + in_y]) & whole[:n])[0])


def _match(batch: pa.Array, s: Items):
    out_n, out_hits, out_items, out_long = [], [], [], []
    for i, j, buf, offs in chunks(batch):
        shard = Shard(buf, offs, s)
        first = shard.first
        items: list[set] = [set() for _ in range(j - i)]
        longest: list[list] = [[] for _ in range(j - i)]
        edge = np.zeros(len(shard.ids) + 1, np.int64)
        for item, width, at in shard.search(s):
            edge[at] += 1
            np.add.at(edge, at + width, -1)
            words = s.ids[s.first[item] : s.first[item + 1]]
            row = np.searchsorted(first, at, "right") - 1
            for r, a in zip(*np.unique(row, return_index=True), strict=True):
                items[r].add(s.names[item])
                mine = at[row == r] if len(row) < 64 else at[a : np.searchsorted(row, r, "right")]
                begin = int(mine[0])
                length, p, q = (width, 0, 0) if len(words) == width else longest_common(shard.ids[begin : int(mine[-1]) + width], words)
                longest[r].append({"item": s.names[item], "item_word": p, "word": begin + q - int(first[r]), "length": length})
        inside = np.cumsum(edge[:-1]) > 0
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        begins[first[:-1][first[:-1] < len(inside)]] |= inside[first[:-1][first[:-1] < len(inside)]]
        last = first[1:][first[1:] > 0] - 1
        ends[last] |= inside[last]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        hits: list[list] = [[] for _ in range(j - i)]
        for r, a, b in zip((np.searchsorted(first, begins, "right") - 1).tolist(), begins.tolist(), ends.tolist(), strict=True):
            hits[r].append({"start": a - int(first[r]), "length": b - a})
        out_n += np.diff(first).tolist()
        out_hits += hits
        out_items += [sorted(x) for x in items]
        out_long += longest
    return out_n, out_hits, out_items, out_long


def _blocks(benchmark: DataFrame, block_bytes: int):
    """Items in blocks of bounded bytes; only one block is on the driver at a time."""
    block, size = [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), text_or_empty().alias("t")).distinct().orderBy("i", "t").toLocalIterator():
        n = len(r["t"].encode("utf-8"))
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    yield block


def find(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = 32 << 20) -> DataFrame:
    """docs with n_words, n_hit (words inside a window's occurrence), items (ids found, sorted), longest (of each item found the
    longest verbatim match and where it is) and contaminated (5 % of the words or more are hit)."""
    kind = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("items", pa.list_(pa.string())), ("longest", pa.list_(pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("length", pa.int64())])))])

    def searcher(held):
        @F.arrow_udf(_FOUND)
        def found(text: pa.Array) -> pa.Array:
            parts = [pa.array(v, f.type) for v, f in zip(_match(text, held.value), kind, strict=True)]
            trim()
            return pa.StructArray.from_arrays(parts, [f.name for f in kind])

        return found.asNondeterministic()

    names = ["n_words", "hits", "items", "longest"]
    own = dict(zip(names, [f"__{n}" for n in names], strict=True))
    spark, blocks = docs.sparkSession, _blocks(benchmark, block_bytes)
    block, nxt = next(blocks), next(blocks, None)
    if nxt is None:
        held = spark.sparkContext.broadcast(items_of(block, window))
        out = append_struct(docs.withColumn("__text", text_or_empty()), searcher(held)(F.col("__text")), names).withColumnsRenamed(own)
    else:
        # Each block's finds are stored before the next block is loaded, so that one block at a time is on the executors, however many there are.
        rows = stored(docs.withColumns({"__text": text_or_empty(), "__row": F.monotonically_increasing_id()}), "decontaminate-rows")
        found = []
        while block is not None:
            held = spark.sparkContext.broadcast(items_of(block, window))
            told = rows.select("__row", searcher(held)(F.col("__text")).alias("f")).select("__row", "f.*")
            found.append(stored(told if not found else told.where(F.size("hits") > 0), "decontaminate-block"))
            held.destroy()
            block, nxt = nxt, next(blocks, None)
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        lists = [F.array_sort(F.flatten(F.collect_list("hits"))), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))), F.array_sort(F.flatten(F.collect_list("longest")))]
        merged = every.groupBy("__row").agg(F.max("n_words").alias("__n_words"), *[c.alias(own[n]) for c, n in zip(lists, names[1:], strict=True)])
        out = rows.join(merged, "__row").drop("__row")
    # Runs of several blocks may overlap: each counts what reaches past those before it.
    covered = F.aggregate(
        "__hits",
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, h: F.struct(
            F.greatest(acc["end"], h["start"] + h["length"]).alias("end"),
            (acc["n"] + F.greatest(h["start"] + h["length"] - F.greatest(acc["end"], h["start"]), F.lit(0).cast("long"))).alias("n"),
        ),
    )["n"]
    held = out.withColumn("__n_hit", covered)
    contaminated = (F.col("__n_hit") > 0) & (20 * F.col("__n_hit") >= F.col("__n_words"))
    done = append(held, F.col("__n_words"), F.col("__n_hit"), F.col("__items"), F.col("__longest"), contaminated, names=RESULTS)
    return done.drop("__text", "__n_words", "__hits", "__items", "__longest", "__n_hit")


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The documents that are not contaminated, with the columns of docs."""
    flagged = find(docs.withColumns({f"__kept_{c}": docs[f"`{c}`"] for c in docs.columns if c.lower() in RESULTS}), benchmark, window)
    clean = flagged.where(~F.col("contaminated"))
    return clean.select(*[F.col(f"`__kept_{c}`").alias(c) if c.lower() in RESULTS else F.col(f"`{c}`") for c in docs.columns])
