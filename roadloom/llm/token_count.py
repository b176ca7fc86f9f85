"""Token counts by byte-pair merging with a heap of adjacent pairs over a linked list.

The vocabulary file (byte-level BPE, `tokenizers` JSON format) gives the merge ranks. A text is
split at special strings (one token each, as the library does by default), each remaining part at the file
format's fixed pattern, and each piece starts as one symbol a byte. The adjacent pair of
the lowest rank (leftmost on ties) is popped and joined until no pair has a rank. The count
of a piece is its bytes minus its merges; no identifiers are made. Counts of pieces
are remembered in each worker up to a stated number of pieces.

Defined results: null counts as empty, with 0 bytes and 0 tokens. Rows do not affect one another. Columns
named like a result are replaced. Very long texts and pieces cost n log n.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from roadloom.llm.common import append_struct, text_or_empty

RESULTS = ["n_bytes", "n_tokens", "over_limit"]

#: Fixed value: the pattern of the byte-level pre-tokenizer.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces whose counts a worker remembers, and the longest piece worth remembering.
REMEMBERED, LONGEST = 400_000, 64

_loaded: dict[str, BytePairCounter] = {}


def _byte_symbols() -> dict[str, int]:
    """The file format's printable stand-ins for bytes: printable Latin-1 stands for itself, the others follow from 256."""
    direct = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(direct)]
    return {chr(b): b for b in direct} | {chr(256 + k): b for k, b in enumerate(rest)}


class BytePairCounter:
    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer") or spec["model"].get("ignore_merges"):
            raise ValueError("only plain byte-level BPE vocabularies can be counted")
        symbol = {chr(c): i for c, i in ((ord(k), v) for k, v in _byte_symbols().items())}
        names: dict[str, int] = dict(symbol)
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            joined = names.setdefault(left + right, len(names))
            self.pairs[names[left] << 32 | names[right]] = (rank, joined)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])):
            raise ValueError("special strings that take in their surroundings are not supported")
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, int] = {}

    def piece(self, text: str) -> int:
        """Tokens of one piece."""
        symbols = list(text.encode("utf-8"))
        n, pairs = len(symbols), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = pairs.get(symbols[i] << 32 | symbols[i + 1])
            if found:
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one side has been merged since
            symbols[i], symbols[j] = joined, -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = pairs.get(joined << 32 | symbols[k])
                if found:
                    heapq.heappush(heap, (found[0], i, joined, symbols[k], found[1]))
            h = before[i]
            if h >= 0:
                found = pairs.get(symbols[h] << 32 | joined)
                if found:
                    heapq.heappush(heap, (found[0], h, symbols[h], joined, found[1]))
        return n - merges

    def count(self, text: str) -> int:
        parts, total = [text], 0
        if self.split and any(s in text for s in self.special):
            parts = self.split.split(text)
            total = len(parts) - 1
        known = self.known
        for part in parts:
            for p in self.pieces.findall(part):
                n = known.get(p)
                if n is None:
                    n = self.piece(p)
                    if len(p) <= LONGEST:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[p] = n
                total += n
        return total


def share_vocabulary(spark: SparkSession, path: str):
    """The file's text as a broadcast; its size is that of one vocabulary, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit). vocabulary: path of the JSON file on the driver."""
    from pyspark.sql import functions as F

    held = share_vocabulary(docs.sparkSession, vocabulary)

    @F.arrow_udf("n_bytes long, n_tokens long, over_limit boolean")
    def counted(text: pa.Array) -> pa.Array:
        if vocabulary not in _loaded:
            _loaded[vocabulary] = BytePairCounter(held.value)
        count = _loaded[vocabulary].count
        n = np.fromiter((count(t.as_py()) for t in text), dtype=np.int64, count=len(text))
        size = pc.binary_length(text).cast(pa.int64())
        return pa.StructArray.from_arrays([size, pa.array(n), pa.array(n > limit)], RESULTS)

    return append_struct(docs, counted.asNondeterministic()(text_or_empty()), RESULTS)
