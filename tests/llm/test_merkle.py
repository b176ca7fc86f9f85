"""The manifest against a tree built level by level, with blocks of several sizes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from roadloom.llm import merkle

R = random.Random(7)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def rows(sizes):
    out, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            text = R.choice([None, "", "Ab c", "lower", "É Z" * R.randint(1, 5)])
            out.append((i, R.choice(["s", None]), lang, R.choice([None, len(text or "")]), text, "clash"))
            i += 1
    return out + [out[0], out[0], (out[0][0], "other", *out[0][2:]), (None, None, None, None, "No id", "clash")]


def leaf(row, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def plain(table):
    groups = defaultdict(list)
    for r in table:
        groups[r[2]].append(r)
    path, subroot = defaultdict(list), {}

    def build(nodes):
        """root and, for each node, the (left, right) texts of its runs."""
        where, paths, level = list(range(len(nodes))), [[] for _ in nodes], nodes
        while len(level) > 1:
            runs = [level[i : i + 8] for i in range(0, len(level), 8)]
            for i, at in enumerate(where):
                run, k = runs[at // 8], at % 8
                paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
                where[i] = at // 8
            level = [sha(*run) for run in runs]
        return level[0], paths

    ordered = {}
    for lang, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        subroot[lang], path[lang] = build([leaf(r, r[4]) for r in own])
        ordered[lang] = own
    langs = sorted(subroot, key=lambda x: (x is not None, (x or "").encode()))
    root, above = build([subroot[x] for x in langs])
    out = []
    for lang, tail in zip(langs, above):
        for r, head in zip(ordered[lang], path[lang]):
            tampered = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if tampered and r[4] is not None else r[4]
            node = leaf(r, text)
            for left, right in head + tail:
                node = sha(left, node, right)
            out.append((r[0], leaf(r, r[4]), subroot[lang], root, sha(*(x for pair in head + tail for x in pair)), node, node == root))
    return sorted(out, key=str)


SIZES = {"en": 700, "fr": 64, "de": 65, None: 8, "it": 1, "é": 9, "z": 513}


@pytest.mark.parametrize(("sizes", "depth"), [(SIZES, 1), (SIZES, 3), ({"en": 1}, 3), ({f"l{i}": 1 for i in range(70)}, 1)])
def test_manifest(spark, sizes, depth):
    table = rows(sizes)
    docs = spark.createDataFrame(table, "doc_id long, source string, lang string, n_chars long, text string, LEAF string").repartition(5)
    got = merkle.manifest(docs, depth).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(table)


def test_paths_lead_to_the_root(spark):
    table = rows({"en": 600, "fr": 20})
    docs = spark.createDataFrame(table, "doc_id long, source string, lang string, n_chars long, text string, x string")
    for r in merkle.manifest(docs, 2, paths=True).collect():
        node = r.leaf
        for side in r.path:
            node = sha(side.left, node, side.right)
        assert node == r.root


def test_manifest_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(docs).count() == 0


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 300, 512])
def test_traversal_holds_little(n):
    block = [sha(str(i)) for i in range(n)]
    depth = min(merkle.levels(n), 3)
    for i, path in enumerate(merkle.traverse(block, depth)):
        node = block[i]
        for run, k in path:
            assert run[k] == node and len(run) <= 8
            node = sha(*run)
        assert node == merkle.block_root(block, depth)
