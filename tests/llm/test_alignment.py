"""Alignment against a plain walk over both token lists, on texts cut into spans and segments of any size."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from roadloom.llm import alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
R = random.Random(11)
SIGNS = list("abcdetn   .,'\n\t09") + ["é", "ß", "日", "本", "\U0001f600", "<|endoftext|>", "<0x41>", "the ", "▁"]
TEXTS = ["", None, " ", "a", "  two  spaces ", "<|endoftext|> and </s><s>", "don't stop", "naïve 日本語 \U0001f600!", "\x00\x7f", "x" * 700, " " * 2500, "same text", "same text"]
TEXTS += ["".join(R.choices(SIGNS, k=R.randint(1, 300))) for _ in range(60)]
ROWS = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, "a second row of one id", "clash"), (None, "no id", "clash")]


def plain(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) by walking over both lists."""
    library = Tokenizer.from_file(A_PATH)
    library.encode_special_tokens = True
    with open(A_PATH, "rb") as a, open(B_PATH, "rb") as b:
        side_a, side_b = alignment.byte_vocabulary(a.read()), alignment.piece_vocabulary(b.read())
    counts, walked = Counter(), []
    for doc_id, text, *_ in rows:
        whole = (" " + (text or "")).encode()
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = side_b.encode(text) if text else []
        if not text or b"".join(side_a.token[i] for i in a) != whole or b"".join(side_b.token[i] for i in b) != whole:
            walked.append((doc_id, [], [], [], []))
            continue
        assert side_a.encode(text) == a
        ends = [[sum(len(side.token[i]) for i in ids[: n + 1]) for n in range(len(ids))] for side, ids in ((side_a, a), (side_b, b))]
        links = [(x, y) for x, e in zip(a, ends[0]) for y, f in zip(b, ends[1]) if max(e - len(side_a.token[x]), f - len(side_b.token[y])) < min(e, f)]
        groups, last = [], 0
        for stop in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(x) for x, e in zip(ids, at) if last < e <= stop) for ids, at in zip((a, b), ends)))
            last = stop
        counts.update(links)
        walked.append((doc_id, a, b, groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for doc_id, a, b, groups, links in walked:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize(("span", "segment"), [(1 << 16, 1 << 22), (7, 60), (150, 1000)])
def test_alignment(spark, span, segment):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n_A string").repartition(3)
    got = alignment.align(docs, A_PATH, B_PATH, span, segment).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(ROWS)


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, A_PATH, B_PATH).count() == 0


def test_long_text_and_links(spark):
    text = "some words, 日本 and\n" * 8000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    links = alignment.links(docs, A_PATH, B_PATH, 1000).orderBy("start").collect()
    assert links[0].start == 0 and links[-1].end == len(text.encode()) + 1
    assert all(x.end == y.start and x.group_no <= y.group_no for x, y in zip(links, links[1:]))
    (row,) = alignment.align(docs, A_PATH, B_PATH).collect()
    assert (row.n_links, row.n_groups) == (len(links), links[-1].group_no + 1)


def test_fast_encoder_is_the_library(spark):
    with open(A_PATH, "rb") as f:
        side = alignment.byte_vocabulary(f.read())
    library = Tokenizer.from_file(A_PATH)
    library.encode_special_tokens = True
    for _ in range(2000):
        text = "".join(R.choice(SIGNS) if R.random() < 0.8 else chr(R.choice([R.randint(32, 0x2FF), R.randint(0x3000, 0xD000), R.randint(0x10000, 0x1F9FF)])) for _ in range(R.randint(1, 60)))
        assert side.encode(text) == library.encode(" " + text, add_special_tokens=False).ids
