"""Alignment of two tokenizers' tokens by a sweep over the byte offsets at which tokens end.

Both token sequences of a text become end events on one line of byte offsets (A reads a space and the text, B reads
the text and adds the space itself). Events of both sides are united, repartitioned by document, sorted by offset inside
partitions and streamed through a machine. An event row carries the events of one side in one span of `SPAN` bytes: the
offset at which its first token starts and the ids in order, of which a vocabulary's lengths give every end. Its last id
may be the token that runs on beyond the span, so that each span can be merged by itself.

Each different offset at which a token ends closes one link, the pair of tokens that cover the bytes before it; an
offset at which both sides end closes a group. Between spans the machine keeps counters, a running SHA-256 and the
B ids of the group that is still open.

Counts of id pairs are taken over all documents. The machine numbers the pairs of a segment (about `SEGMENT` links,
whatever documents they are of), so a task holds one segment's pairs; each segment's pairs are summed over segments,
the highest count of each B id is found, and both come back to the segment's documents by its number.

Defined results: a text that is null, empty, or whose joined bytes on either side differ from a space and the
text has no tokens; its counts are 0 and groups_sha256 is ''. Rows with equal ids or texts stay separate rows. Other columns
of the input are not looked at. One text is encoded in the memory of one task; its events are spread over rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roadloom.llm.common import discard, shared_dir, stored, stored_at, text_or_empty, trimmed
from roadloom.llm.token_count import PIECES, _byte_symbols

#: Bytes of text that one row of events covers.
SPAN = 1 << 16
#: Links of a segment, which bounds what one task holds of pairs.
SEGMENT = 1 << 22
#: Bytes of events that one Arrow batch holds about.
BATCH = 1 << 21

EVENTS = "doc long, at long, side int, doc_id long, start long, ids binary"
SWEPT = "segment long, doc long, doc_id long, n_a long, n_b long, n_groups long, n_links long, digest string, place array<int>, times array<int>, pair array<long>, kind int"


@dataclass
class Vocabulary:
    """How one side encodes: ids of a text, and the bytes of each id."""

    encode: Callable[[str], list[int]]
    token: list[bytes]

    def __post_init__(self):
        self.lengths = np.array([len(t) for t in self.token], np.int64)
        self.dtype = np.dtype("<u2" if len(self.token) <= 1 << 16 else "<u4")

    def fits(self, ids: list[int], whole: bytes) -> bool:
        return b"".join(map(self.token.__getitem__, ids)) == whole


def byte_vocabulary(spec: bytes) -> Vocabulary:
    """Side A from a byte-level BPE file of `tokenizers`; it reads a space and the text.

    Where merges are listed in the order of their ids, the same vocabulary is run by tiktoken, several times as fast; long
    runs of white space, which its pattern cannot take, go through `tokenizers`.
    """
    parsed = json.loads(spec)
    ids, stands = parsed["model"]["vocab"], _byte_symbols()
    special = {t["content"]: t["id"] for t in parsed.get("added_tokens", [])}
    token = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for text, i in (ids | special).items():
        token[i] = text.encode() if text in special else bytes(map(stands.__getitem__, text))
    library = Tokenizer.from_str(spec.decode())
    library.encode_special_tokens = True

    def plain(text: str) -> list[int]:
        return library.encode(" " + text, add_special_tokens=False).ids

    made = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in parsed["model"]["merges"]]
    if any(x >= y for x, y in zip(made, made[1:])) or not parsed["pre_tokenizer"].get("use_regex", True):
        return Vocabulary(plain, token)
    ranks = {token[i]: i for text, i in ids.items() if text not in special}
    fast = tiktoken.Encoding("bytes", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    long_space = re.compile(r"\s{1000}")
    return Vocabulary(lambda text: plain(text) if long_space.search(text) else fast.encode_ordinary(" " + text), token)


def piece_vocabulary(model: bytes) -> Vocabulary:
    """Side B from a sentencepiece model, which adds the space."""
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [library.id_to_piece(i) for i in range(library.vocab_size())]
    token = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Vocabulary(lambda text: library.encode(text, num_threads=1), token)


_loaded: dict[int, tuple[Vocabulary, Vocabulary]] = {}


def _vocabularies(held) -> tuple[Vocabulary, Vocabulary]:
    """The two sides, loaded once a worker."""
    if held.value[2] not in _loaded:
        _loaded[held.value[2]] = byte_vocabulary(held.value[0]), piece_vocabulary(held.value[1])
    return _loaded[held.value[2]]


def _share(spark: SparkSession, a_path: str, b_path: str):
    """Both files as one broadcast; its size is that of two vocabularies, whatever the corpus."""
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        files = a.read(), b.read()
    return spark.sparkContext.broadcast((*files, hashlib.sha256(files[0] + files[1]).hexdigest()))


def _spans(ids: np.ndarray, ends: np.ndarray, span: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(offset of the span, offset at which its first token starts, its ids and the next one) of one side."""
    total, i = int(ends[-1]), 0
    for at in range(0, total, span):
        j = int(np.searchsorted(ends, at + span, "right"))
        yield at, int(ends[i - 1]) if i else 0, ids[i : j + 1]
        i = j


def events(docs: DataFrame, held, span: int = SPAN) -> DataFrame:
    """End events of both sides of every text; a text without tokens gives one empty row."""

    def encode(batches):
        sides, pack = _vocabularies(held), zstandard.ZstdCompressor(level=1).compress
        rows, size = [], 0
        for b in batches:
            for doc, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = text.as_py()
                whole = b" " + text.encode()
                ids = [side.encode(text) for side in sides] if text else []
                if ids and all(side.fits(i, whole) for side, i in zip(sides, ids)):
                    for k, (side, found) in enumerate(zip(sides, ids)):
                        found = np.array(found, side.dtype)
                        if len(whole) <= span:
                            spans = [(0, 0, found)]
                        else:
                            spans = _spans(found, np.cumsum(side.lengths[found]), span)
                        for at, start, part in spans:
                            rows.append((doc, at, k, None if k or at else doc_id, start, pack(part.tobytes())))
                            size += len(rows[-1][-1]) + 64
                else:
                    rows.append((doc, 0, 0, doc_id, 0, None))
                    size += 64
                if size > BATCH:
                    yield _rows(rows, EVENTS)
                    rows, size = [], 0
        yield _rows(rows, EVENTS)

    keyed = docs.select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return keyed.mapInArrow(trimmed(encode), EVENTS)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")))
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, k in zip(columns, kinds)], list(names))


class Sweep:
    """The state machine of one document: spans of events in, links out; groups are counted and hashed."""

    def __init__(self, a: Vocabulary, b: Vocabulary, written: list[bytes]):
        self.sides, self.written = (a, b), written
        self.n = [0, 0]
        self.groups = self.links = 0
        self.hash = hashlib.sha256()
        self.open_a = False
        self.open_b = np.zeros(0, np.int64)

    def span(self, at: int, width: int, starts: list[int], ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Merges one span: (a, b, end offset, group) of each link that ends in it."""
        ends, inside = [], []
        for side, start, own in zip(self.sides, starts, ids):
            e = np.cumsum(side.lengths[own])
            e += start
            ends.append(e)
            inside.append(int(np.searchsorted(e, at + width, "right")))
        mark = np.zeros(width + 1, np.uint8)
        for k in (0, 1):
            mark[ends[k][: inside[k]] - at] |= k + 1
        stops = np.flatnonzero(mark)
        kind = mark[stops]
        ends_a, ends_b, both = (kind & 1).astype(np.int64), kind >> 1, kind == 3
        of_a, of_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b, dtype=np.int64) - ends_b
        closed = np.cumsum(both)
        group = closed - both
        links = ids[0].astype(np.int64)[of_a], ids[1].astype(np.int64)[of_b], stops + at, group + self.groups
        self._write(ids[0][: inside[0]], ids[1][: inside[1]], group[ends_a > 0], group[ends_b > 0], int(closed[-1]) if len(stops) else 0)
        for k in (0, 1):
            self.n[k] += inside[k]
        self.links += len(stops)
        return links

    def _write(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, closed: int) -> None:
        """Hashes `a1,a2|b1;a3|b2,b3`: A ids at once, B ids when their group is closed."""
        b = np.concatenate((self.open_b, b.astype(np.int64)))
        group_b = np.concatenate((np.zeros(len(self.open_b), np.int64), group_b))
        lead_a, lead_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
        lead_a[1:], lead_b[1:] = group_a[1:] != group_a[:-1], group_b[1:] != group_b[:-1]
        if len(a) and self.open_a and group_a[0] == 0:
            lead_a[0] = 0
        done = group_b < closed
        size = len(self.written) // 4
        code = np.concatenate((a.astype(np.int64) + lead_a * size, (b + lead_b * 2 * size)[done]))
        place = np.concatenate((2 * group_a, 2 * group_b[done] + 1))
        if len(a) and not self.n[0]:
            code[0] = int(a[0]) + 3 * size
        self.hash.update(b"".join(map(self.written.__getitem__, code[np.argsort(place, kind="stable")].tolist())))
        self.open_b = b[~done]
        self.open_a = bool(len(group_a) and group_a[-1] == closed) or (closed == 0 and self.open_a)
        self.groups += closed


def _written(a: Vocabulary, b: Vocabulary) -> list[bytes]:
    """Every id as it follows another (`,`), opens an A side (`;`), opens a B side (`|`) and opens a text."""
    size = max(len(a.token), len(b.token))
    return [b"%s%d" % (mark, i) for mark in (b",", b";", b"|", b"") for i in range(size)]


def _swept(batches, a: Vocabulary, b: Vocabulary, span: int):
    """(doc, doc_id, machine, links of the span or None) over sorted events; a document's last one has None."""
    written, unpack = _written(a, b), zstandard.ZstdDecompressor().decompress
    now = machine = first = None
    for batch in batches:
        for doc, at, side, doc_id, start, ids in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if doc != now:
                if machine:
                    yield now, now_id, machine, None
                now, now_id, machine = doc, doc_id, Sweep(a, b, written)
            if ids is None:
                continue
            ids = np.frombuffer(unpack(ids), (a, b)[side].dtype)
            if side == 0:
                first = start, ids
            else:
                yield now, now_id, machine, machine.span(at, span, [first[0], start], [first[1], ids])
    if machine:
        yield now, now_id, machine, None


def _sorted_events(docs: DataFrame, held, span: int) -> DataFrame:
    return events(docs, held, span).repartition("doc").sortWithinPartitions("doc", "at", "side")


def links(docs: DataFrame, a_path: str, b_path: str, span: int = SPAN) -> DataFrame:
    """doc_id, group_no, start, end, a, b of every link: byte offsets in a space and the text."""
    held = _share(docs.sparkSession, a_path, b_path)
    schema = "doc_id long, group_no long, start long, end long, a long, b long"

    def run(batches):
        last = now = None
        for doc, doc_id, _, found in _swept(batches, *_vocabularies(held), span):
            if found is not None and len(found[0]):
                a, b, end, group = found
                start = np.concatenate(([last if doc == now else 0], end[:-1]))
                last, now = end[-1], doc
                ids = pa.array([doc_id] * len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (group, start, end, a, b))], [c.split(" ")[0] for c in schema.split(", ")])

    return _sorted_events(docs, held, span).mapInArrow(run, schema)


def align(docs: DataFrame, a_path: str, b_path: str, span: int = SPAN, segment: int = SEGMENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs."""
    spark = docs.sparkSession
    held = _share(spark, a_path, b_path)

    def sweep(batches):
        a, b = _vocabularies(held)
        size, number = len(b.token), TaskContext.get().partitionId() << 32
        pieces, own, held_links, n = [], [], 0, 0

        def close():
            every = np.unique(np.concatenate([p[1] for p in pieces] or [np.zeros(0, np.int64)]))
            times, rows, total = np.zeros(len(every), np.int64), [], 0
            for head, pairs, count in pieces:
                place = np.searchsorted(every, pairs)
                times[place] += count
                rows.append((number + n, *head, place.astype(np.int32), count.astype(np.int32), None, 1))
                total += len(place)
                if total > BATCH // 8:
                    yield _rows(rows, SWEPT)
                    rows, total = [], 0
            yield _rows(rows, SWEPT)
            for i in range(0, len(every), 1 << 16):
                part = slice(i, i + (1 << 16))
                place = np.arange(i, min(i + (1 << 16), len(every)), dtype=np.int32)
                yield _rows([(number + n, *[None] * 7, place, times[part].astype(np.int32), every[part], 0)], SWEPT)

        for doc, doc_id, machine, found in _swept(batches, a, b, span):
            if found is not None:
                own.append(found[0] * size + found[1])
                held_links += len(own[-1])
            full = held_links >= segment
            if found is None or full:
                pairs, count = np.unique(np.concatenate(own or [np.zeros(0, np.int64)]), return_counts=True)
                counted = (*machine.n, machine.groups, machine.links, machine.hash.hexdigest() if machine.links else "")
                pieces.append(((doc, doc_id, *(counted if found is None else (0, 0, 0, 0, ""))), pairs, count))
                own = []
            if full or len(pieces) >= segment // 16:
                yield from close()
                pieces, held_links, n = [], 0, n + 1
        yield from close()

    folder = shared_dir(spark, "alignment-swept")
    swept = stored_at(_sorted_events(docs, held, span).mapInArrow(trimmed(sweep), SWEPT), folder)
    size = piece_vocabulary(held.value[1]).lengths.size
    pairs = swept.where("kind = 0").select("segment", F.explode(F.arrays_zip("place", "times", "pair")).alias("p")).select("segment", "p.place", "p.times", "p.pair")
    totals = pairs.groupBy("pair").agg(F.sum("times").alias("count"))
    # The rows of one B id are at most as many as A has ids.
    highest = F.max("count").over(Window.partitionBy(F.expr(f"pair % {size}")))
    totals = stored(totals.select("pair", "count", (F.col("count") == highest).alias("best")), "alignment-pairs")
    told = pairs.join(totals, "pair").select("segment", "place", "count", "best")

    doc_columns = ["doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "digest"]
    of_docs = swept.where("kind = 1").select("segment", F.lit(-1).alias("at"), *doc_columns, "place", "times", F.lit(None).cast("long").alias("count"), F.lit(None).cast("boolean").alias("best"))
    empty = [F.lit(None).cast(of_docs.schema[c].dataType).alias(c) for c in [*doc_columns, "place", "times"]]
    of_pairs = told.select("segment", F.col("place").alias("at"), *empty, "count", "best")
    judged_schema = "doc long, doc_id long, n_a long, n_b long, n_groups long, n_links long, digest string, count_sum long, n_best long"
    both = of_pairs.union(of_docs.withColumn("at", F.lit((1 << 31) - 1))).repartition("segment").sortWithinPartitions("segment", "at", "doc")

    def judge(batches):
        now, counts, bests, ready = None, [], [], None
        for b in batches:
            segment_of = b.column("segment").to_numpy()
            cuts = [0, *(np.flatnonzero(segment_of[1:] != segment_of[:-1]) + 1), len(segment_of)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if segment_of[i] != now:
                    now, counts, bests, ready = segment_of[i], [], [], None
                part = b.slice(i, j - i)
                k = part.column("doc").null_count  # pairs come before documents
                if k:
                    counts.append(part.column("count").slice(0, k).to_numpy())
                    bests.append(part.column("best").slice(0, k).to_numpy(zero_copy_only=False))
                if k == len(part):
                    continue
                if ready is None:
                    none = np.zeros(0, np.int64)
                    ready = np.concatenate([*counts, none]).astype(np.int64), np.concatenate([*bests, none]).astype(np.int64)
                rows = part.slice(k)
                place, times = rows.column("place"), rows.column("times")
                at = np.concatenate(([0], np.cumsum(place.value_lengths().to_numpy())))
                place, times = place.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
                sums = []
                for values in ready:
                    total = np.concatenate(([0], np.cumsum(values[place] * times)))
                    sums.append(pa.array(total[at[1:]] - total[at[:-1]], pa.int64()))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in doc_columns), *sums], [*doc_columns, "count_sum", "n_best"])

    judged = both.mapInArrow(trimmed(judge), judged_schema)
    # A document whose links end in several segments has a row in each.
    whole = judged.groupBy("doc").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], F.max("digest").alias("groups_sha256"))
    out = whole.drop("doc")
    result = stored(out, "alignment")
    discard(spark, folder)
    return result
