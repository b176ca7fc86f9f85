"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roadloom.llm import chat_format, decontaminate, exact_dedup, jaccard_join, language_id, licenses, mixing, quality, sharding, token_count

VOCABULARY = "byte_bpe_50k.json"
R = random.Random(5)
WORDS = ["".join(R.choices("abcdeéü", k=R.randint(1, 7))) for _ in range(400)]


def text(n):
    return " ".join(R.choices(WORDS, k=n))


BASE = [text(R.randint(30, 120)) for _ in range(30)]


def near(t):
    w = t.split()
    for _ in range(R.randint(1, 3)):
        w[R.randrange(len(w))] = R.choice(WORDS)
    return " ".join(w)


TEXTS = [*BASE, *BASE[:5], *[near(BASE[0]) for _ in range(12)], *[near(R.choice(BASE)) for _ in range(20)], None, "", "   \t", "one", "One", "a b", "A  b\n", text(30_000), "don't   stop\u0085now <|endoftext|> x" + "z" * 300, "12 345 $$$"]
ROWS = [(i, t, ["en", "fr", None][i % 3], [None, "b", "a", "\U0001f600"][i % 4], "clash") for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, lang string, source string, {} string"


def table(spark, clash, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA.format(clash)).repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize(("marks", "large"), [(2_000_000, 1024), (0, 1024), (2_000_000, 1), (0, 10)])
def test_exact_dedup(spark, monkeypatch, marks, large):
    monkeypatch.setattr(exact_dedup, "MARKS", marks)
    monkeypatch.setattr(exact_dedup, "LARGE", large)
    got = by_id(exact_dedup.deduplicate(table(spark, "Kept"), bucket_entries=4, owners=3))
    groups = defaultdict(list)
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, *_ in ROWS}
    for i, n in norm.items():
        groups[n].append(i)
    for i, n in norm.items():
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(groups[n]), len(groups[n]), i == min(groups[n]))
        assert got[i].text_sha256 == hashlib.sha256(n.encode()).hexdigest()


def test_exact_dedup_null_ids_and_empty(spark):
    rows = [(None, "a", None, None, None), (3, "a", None, None, None), (3, "a", None, None, None), (None, "b", None, None, None)]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(table(spark, "x", rows)).collect()), key=str)
    assert got == sorted([(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, None, 1, True)], key=str)
    assert exact_dedup.deduplicate(table(spark, "x", [])).count() == 0


def test_only_the_overfull_bucket_splits(spark):
    low, high = [i << 50 for i in range(40)], [-1 - (i << 58) for i in range(3)]  # top bit 0 and 1
    chains = spark.createDataFrame([(h,) for h in low + high], "h long")
    found = {(r.depth, r.prefix): r.n for r in exact_dedup.buckets(chains, 10).collect()}
    assert found.pop((1, 1)) == 3  # the sibling stays whole at depth 1
    assert sum(found.values()) == 40 and max(found.values()) <= 10 and min(d for d, _ in found) > 1
    slots, depth = exact_dedup.directory(chains, 10, owners=4)
    rows = slots.collect()
    assert depth == max(d for d, _ in found) and len({r.slot for r in rows}) == len(rows)
    assert sum(r.bucket == 1 << (depth - 1) for r in rows) == 1 << (depth - 1)  # half of the directory names one bucket
    by_bucket = sorted({(r.bucket, r.owner) for r in rows})
    assert [o for _, o in by_bucket] == sorted(o for _, o in by_bucket) and len(by_bucket) == len(found) + 1  # owners have ranges of keys
    links = chains.selectExpr("h", "unhex(hex(h)) sha", "h keep", "1L n")
    kept = exact_dedup.index(links, slots, depth, 4)
    assert kept.count() == 43 and kept.agg(F.sum("chain")).first()[0] == 43
    spread = [r.files for r in kept.select("bucket", F.input_file_name().alias("f")).distinct().groupBy("bucket").agg(F.count("*").alias("files")).collect()]
    assert spread == [1] * (len(found) + 1)  # a bucket lies in one file


def test_a_bucket_of_one_hash_stays_one_bucket(spark):
    chains = spark.createDataFrame([(i,) for i in range(30)], "h long")  # all 44 leading bits equal
    assert [tuple(r) for r in exact_dedup.buckets(chains, 10).collect()] == [(exact_dedup.MOST_DEPTH, 0, 30)]


def test_token_counts(spark):
    path = public_tokenizers.path(VOCABULARY)
    got = by_id(token_count.count_tokens(table(spark, "n_tokens"), path))
    lib = Tokenizer.from_file(path)
    for i, t, *_ in ROWS:
        assert got[i].n_tokens == len(lib.encode(t or "", add_special_tokens=False).ids)
        assert got[i].n_bytes == len((t or "").encode())
        assert got[i].over_limit == (got[i].n_tokens > 1024)


def test_token_counts_of_an_empty_table(spark):
    assert token_count.count_tokens(table(spark, "x", []), public_tokenizers.path(VOCABULARY)).count() == 0


def test_token_counts_of_odd_characters():
    path = public_tokenizers.path(VOCABULARY)
    counter, lib = token_count.BytePairCounter(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    rng = random.Random(1)
    for _ in range(400):
        t = "".join(rng.choice(["a", "B", " ", "  ", "\n", "'s", "'", "9", "²", "é", "中", "\u0085", "\x1c", "\u200b", "\U0001f600", "<|endoftext|>", "ß", "٣"]) for _ in range(rng.randint(0, 25)))
        assert counter.count(t) == len(lib.encode(t, add_special_tokens=False).ids), repr(t)


def test_sharding(spark):
    docs = table(spark, "Shard").union(table(spark, "Shard"))
    rows = sharding.shard(docs, shards=3, slots=64).collect()
    assert len(rows) == 2 * len(ROWS) and {r.law for r in rows} == {"bytes"}
    load = defaultdict(list)
    for r in rows:
        t = (TEXTS[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t))
        load[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in load.values()) and set(load) <= {0, 1, 2}
    assert sharding.shard(table(spark, "x", []), shards=3, slots=16).count() == 0


def test_sharding_balances_bytes_and_takes_null_ids(spark):
    rng = random.Random(3)
    rows = [(None if i % 3 == 0 else i, "x" * rng.randrange(400), None, None, None) for i in range(4000)] + [(None, "same", None, None, None)] * 500
    got = sharding.shard(table(spark, "x", rows), shards=4, slots=256).collect()
    held, place = defaultdict(int), defaultdict(list)
    for r in got:
        held[r.shard] += r.size
        place[r.shard].append(r.slot)
    assert len(got) == len(rows) and sum(held.values()) == sum(len(r[1]) + 1 for r in rows)
    assert max(held.values()) - min(held.values()) <= 0.02 * sum(held.values())
    assert all(sorted(v) == list(range(len(v))) for v in place.values())
    many = sharding.shard(table(spark, "x", rows), shards=4, slots=1)  # one slot: its parts keep the positions gapless
    assert sorted(r.slot for r in many.collect()) == list(range(len(rows)))


def test_rebalancing_edits_the_map(spark):
    loads = spark.createDataFrame([(i, 100 + i % 7) for i in range(60)], "virtual_slot int, bytes long")
    old = sharding.assign(loads, 5, 64)
    new = sharding.assign(loads, 6, 64, old, version=2)
    before, after = ({r.virtual_slot: r.shard for r in m.collect()} for m in (old, new))
    held = defaultdict(int)
    for r in new.collect():
        held[r.shard] += r.bytes
    assert set(after) == set(range(64)) and max(held.values()) < 1.2 * min(held.values())
    assert sum(before[s] != after[s] for s in before) <= 20


ITEMS = [(1, " ".join(WORDS[:30])), (2, "Only four words here"), (3, None), (4, " ".join(WORDS[20:45])), (4, "only four words here"), (None, "x-y"), (5, "...")]
DIRTY = [(100, text(50) + " " + " ".join(WORDS[5:25]) + "! " + text(10)), (101, "only FOUR words, here"), (102, " ".join(WORDS[:12])), (103, text(600) + " " + " ".join(WORDS[:13])), (104, "x y"), (105, " ".join(WORDS[25:45]) + " " + " ".join(WORDS[20:40]))]


def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def expected_hits(items, t, window):
    w, hit, found, longest = bench_words(t), set(), set(), {}
    for item, s in items:
        b = bench_words(s)
        k = min(window, len(b))
        at = defaultdict(list)
        for q in range(len(w) - k + 1):
            at[tuple(w[q : q + k])].append(q)
        name = "" if item is None else str(item)
        for p in range(len(b) - k + 1 if b else 0):
            for q in at.get(tuple(b[p : p + k]), ()):
                hit |= set(range(q, q + k))
                found.add(name)
                n = next((n for n in range(k, len(b)) if p + n >= len(b) or q + n >= len(w) or b[p + n] != w[q + n]), len(b))
                longest[name, s] = min(longest.get((name, s), (0, 0, 0)), (-n, p, q))
    return len(w), len(hit), sorted(found), sorted((name, p, q, -n) for (name, _), (n, p, q) in longest.items())


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination(spark, block):
    rows = ROWS + [(i, t, None, None, None) for i, t in DIRTY]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = by_id(decontaminate.find(table(spark, "N_hit", rows), bench, block_bytes=block))
    assert any(r.contaminated for r in got.values())
    for i, t, *_ in rows:
        n, hit, items, longest = expected_hits(ITEMS, t, 13)
        r = got[i]
        assert sorted((m["item"], m["item_word"], m["word"], m["length"]) for m in r.longest) == longest, i
        assert (r.n_words, r.n_hit, list(r["items"]), r.contaminated) == (n, hit, items, hit > 0 and 20 * hit >= n), i
    left = decontaminate.remove(table(spark, "n_hit", rows), bench)
    assert left.columns == ["doc_id", "text", "lang", "source", "n_hit"] and left.count() == sum(not r.contaminated for r in got.values())
    assert decontaminate.find(table(spark, "x", []), bench).count() == 0


def test_longest_match(spark):
    bench = spark.createDataFrame([(1, " ".join(WORDS[:30]))], "item_id long, text string")
    r = decontaminate.find(spark.createDataFrame([(1, "q " + " ".join(WORDS[2:22]))], "doc_id long, text string"), bench).first()
    assert [(m["length"], m["item_word"], m["word"]) for m in r.longest] == [(20, 2, 1)]


def test_longest_common_block():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x, y = rng.integers(0, 4, rng.integers(1, 30)), rng.integers(1, 4, rng.integers(1, 30))
        best = min(((-n, q, p) for p in range(len(x)) for q in range(len(y)) for n in range(1, 30) if p + n <= len(x) and q + n <= len(y) and (x[p : p + n] == y[q : q + n]).all() and x[p : p + n].min() > 0), default=(0, 0, 0))
        assert decontaminate.longest_common(x, y) == (-best[0], best[1], best[2])


def test_very_long_items_and_texts_take_bounded_memory():
    import pyarrow as pa
    import resource

    rng = random.Random(3)
    long = [f"w{rng.randrange(50_000)}" for _ in range(200_000)]
    s = decontaminate.items_of([("1", " ".join(long)), ("2", "same " * 200_000)], 13)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n, hits, items, longest = decontaminate._match(pa.array(["x " + " ".join(long), "same " * 200_000, " ".join(long[50:70])]), s)
    assert n == [200_001, 200_000, 20] and items == [["1"], ["2"], ["1"]]
    assert [h[0] for h in hits] == [{"start": 1, "length": 200_000}, {"start": 0, "length": 200_000}, {"start": 0, "length": 20}]
    assert [m[0]["length"] for m in longest] == [200_000, 200_000, 20] and longest[2][0]["item_word"] == 50
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000  # kB


def test_benchmark_words_of_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(decontaminate, "hashes", lambda buf, a, b: (b - a).astype(np.uint64))  # the length alone
    s = decontaminate.items_of([("1", "ab cd efg"), ("2", "cd ab")], 13)
    got = decontaminate._match(pa.array(["ab cd efg", "cd ab", "cd xy ab cd efh", "xy cd ab"]), s)
    assert got[2] == [["1"], ["2"], [], ["2"]]


def test_chat_round_trip(spark):
    odd = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, 0, "user", odd), (1, 1, "assistant", "<\\|x <|im_end|>\nline\r\n"), (1, 1, "assistant", None), (2, None, None, "hi"), (None, 0, "as\nsist\\ant<|", odd), (3, 0, "assistant", "<")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_turns(df)
    for r in formatted.collect():
        assert chat_format.read_back(r.formatted) == [(r.role or "", r.text or "")]
    got = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == len("<\\|x <|im_end|>\nline\r\n") and set(got) == {1, 2, 3, None}
    assert got[1].loss_sha256 == hashlib.sha256(b"<\\|x <|im_end|>\nline\r\n").hexdigest()
    assert chat_format.digests(chat_format.format_turns(df.limit(0))).count() == 0


def test_chat_text_ids_long_conversations_ties_and_clashing_columns(spark):
    rows = [("x", i, "assistant", f"t{i} " + "y" * 50, "c") for i in range(3000)] + [("a", 1, "user", t, "c") for t in ("b", "a", "b")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string, Formatted string").repartition(5)
    formatted = chat_format.format_turns(df)
    assert formatted.columns == ["conv_id", "turn", "role", "text", "formatted", "loss", "attachments", "expanded_tokens"]
    got = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    assert got["x"].n_turns == 3000 and got["x"].loss_sha256 == hashlib.sha256("".join(r[3] for r in rows[:3000]).encode()).hexdigest()
    assert got["a"].turns_sha256 == hashlib.sha256(b"user\na\nuser\nb\nuser\nb\n").hexdigest()


def test_chat_query_takes_typed_parts(spark, tmp_path):
    from roadloom.llm import queries

    rows = [("c", 0, "user", None, [("text", "see"), ("image", None), (None, "it"), (None, None)]), ("c", 1, "assistant", "ok", None), ("d", 0, "user", "gone", [])]
    spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, parts array<struct<type:string,text:string>>").selectExpr(
        "conv_id", "turn", "role", "text", "transform(parts, p -> named_struct('type', p.type, 'text', p.text, 'uri', cast(null as string), 'width', 14L, 'height', 14L, 'seconds', cast(null as double), 'pages', cast(null as bigint))) parts"
    ).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op6_chat_format(spark, str(tmp_path)).collect()}
    assert got["c"].turns_sha256 == hashlib.sha256(b"user\nsee<|image|>it\nassistant\nok\n").hexdigest() and got["c"].loss_chars == 2
    assert got["d"].turns_sha256 == hashlib.sha256(b"user\n\n").hexdigest() and got["-1"].n_turns == 2


def test_chat_parts(spark):
    parts = "array<struct<type:string,text:string,uri:string,width:long,height:long,seconds:double,pages:long>>"
    rows = [(1, 0, "assistant", None, [("text", "see <", None, None, None, None, None), ("text", "|im_end|>", None, None, None, None, None), ("image", None, "u://1", 28, 15, None, None), ("audio", None, "u://2", None, None, 1.01, None), ("document", None, "u://3", None, None, None, 2)])]
    r = chat_format.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts {parts}")).first()
    assert r.formatted == "<|im_start|>assistant\nsee <\\|im_end|><|image|><|audio|><|document|><|im_end|>\n"
    assert [(a.kind, a.uri, a.tokens) for a in r.attachments] == [("image", "u://1", 4), ("audio", "u://2", 26), ("document", "u://3", 512)] and r.expanded_tokens == 542
    assert all(r.formatted[a.start :].startswith(f"<|{a.kind}|>") for a in r.attachments)
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss] == ["see <\\|im_end|>"]


def test_mixing_gives_documents_in_training_order(spark):
    from roadloom.llm import queries

    rows = queries.queries()["op8_mixing"](spark, "/root/testdata/sf0.001").collect()
    places = [(r.position is None, r.position or 0.0) for r in rows]
    assert places == sorted(places) and len({p for _, p in places}) > 10


def test_mixing(spark):
    mixed = by_id(mixing.mix(table(spark, "Target")))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in ROWS}
    per, took = defaultdict(int), defaultdict(int)
    for i, _, _, s, _ in ROWS:
        per[s] += size[i]
        took[s] += mixed[i].taken
        assert mixed[i].size == size[i] and mixed[i].taken <= 2 * size[i]
    order = sorted((s for s in per if s is not None)) + [None]
    weight, full = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, set()
    while True:
        rest, w = 1.5 * sum(per.values()) - sum(2 * per[s] for s in full), sum(weight[s] for s in order if s not in full)
        goal = {s: 2 * per[s] if s in full else rest * weight[s] / w for s in order}
        over = {s for s in order if goal[s] > 2 * per[s] + 1e-9}
        if not over:
            break
        full |= over
    for i, _, _, s, _ in ROWS:
        assert mixed[i].source_size == per[s] and mixed[i].target == pytest.approx(goal[s])
    assert all(abs(took[s] - goal[s]) <= 1 for s in order)
    ordered = mixing.training_order(table(spark, "taken"), partitions=3)
    assert ordered.columns == ["doc_id", "text", "lang", "source", "taken"] and ordered.count() == sum(len(r.passes) for r in mixed.values())
    assert mixing.mix(table(spark, "x", [])).count() == 0


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(zip(*[w[j:] for j in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def linked(rows, k, num, den):
    sets, parent = {i: shingles(t, k) for i, t, *_ in rows}, {i: i for i, *_ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("k", "num", "nodes"), [(4, 85, 2000), (5, 80, 3), (2, 60, 4)])
def test_jaccard_join(spark, monkeypatch, k, num, nodes):
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", nodes)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_classes(table(spark, "component_id"), k, num, 100).collect()}
    assert got == linked(ROWS, k, num, 100)


def test_jaccard_join_ties_the_texts_of_one_id(spark):
    a, b, c = text(60), text(60), text(60)
    rows = [(3, a, None, None, None), (7, near(a) + " q", None, None, None), (7, b, None, None, None), (9, b + " q", None, None, None), (11, c, None, None, None)]
    got = sorted((r.doc_id, r.component_id) for r in jaccard_join.link_classes(table(spark, "x", rows), 4, 70, 100).collect())
    assert got == [(3, 3), (7, 3), (7, 3), (9, 3), (11, 11)]


def test_jaccard_join_of_many_unlike_sets_with_common_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 5)
    common = text(40)
    rows = [(i, common + " " + (text(3) if i % 2 else near(common)), None, None, None) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_classes(table(spark, "x", rows), 3, 85, 100).collect()}
    assert got == linked(rows, 3, 85, 100) and len({c for _, c in got.values()}) > 10


def test_tokens_of_many_nodes_keep_the_same_nodes(spark, tmp_path):
    import pyarrow as pa

    rng = np.random.default_rng(6)
    rows = sorted({(int(t), int(v), int(10 + v % 13 * (t + 1)), bool(rng.random() < 0.4)) for t in range(6) for v in rng.integers(0, 400, 25)}, key=lambda r: (r[0], r[2], not r[3], r[1]))
    rows = list({(t, v): (t, v, n, lead) for t, v, n, lead in reversed(rows)}.values())[::-1]
    rows.sort(key=lambda r: (r[0], r[2], not r[3], r[1]))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["token", "node", "n", "leading"])
    want = {(r["token"], r["node"]) for b in jaccard_join._shared([batch], 85, 100) for r in b.to_pylist()}
    got = jaccard_join._shared_often(spark.createDataFrame(rows, "token long, node long, n long, leading boolean"), 85, 100, f"file://{tmp_path}/each").collect()
    assert {(r.token, r.node) for r in got} == want and len(got) == len(want) and 0 < len(want) < len(rows)


def test_a_set_has_two_hashes():
    sets = [np.unique(np.random.default_rng(i).integers(0, 1 << 62, 40).astype(np.uint64)) for i in range(200)]
    assert len({jaccard_join._node(x) for x in sets}) == len({jaccard_join._check(x) for x in sets}) == 200
    assert all(jaccard_join._check(x) == jaccard_join._check(x.copy()) != jaccard_join._node(x) for x in sets)


def test_jaccard_join_nulls_repeats_and_empty(spark):
    rows = [(None, BASE[0], None, None, None), (7, BASE[0], None, None, None), (7, BASE[0], None, None, None), (9, "", None, None, None)]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.link_classes(table(spark, "x", rows)).collect()), key=str)
    assert got == sorted([(None, None), (7, 7), (7, 7), (9, 9)], key=str)
    assert jaccard_join.link_classes(table(spark, "x", [])).count() == 0
    assert jaccard_join.representatives(table(spark, "n_shingles")).columns == ["doc_id", "text", "lang", "source", "n_shingles"]


def test_prefix_tree_against_all_pairs():
    rng = np.random.default_rng(2)
    for _ in range(30):
        base = rng.integers(1, 60, 25)
        sets = list({tuple(np.unique(np.where(rng.random(25) < 0.15, rng.integers(1, 60, 25), base))) for _ in range(15)})
        sets = [np.array(s, dtype=np.uint64) for s in sets]
        tree = jaccard_join.PrefixTree(sets, list(range(len(sets))))
        for x in sets:
            want = {j for j, y in enumerate(sets) if 100 * len(np.intersect1d(x, y)) >= 70 * len(np.union1d(x, y))}
            assert set(tree.probe(x, 70, 100)) == want


def test_language_id(spark):
    rng = random.Random(2)
    kinds = {"aa": "abcd", "bb": "wxyz", "cc": "éüöß"}
    rows = [(i, " ".join("".join(rng.choices(kinds[lang], k=4)) for _ in range(30)), lang, None, None) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    docs = table(spark, "Lang_pred", [*rows, (900, None, "aa", None, None), (901, "123 !", "bb", None, None), (902, "", None, None, None), (903, "qqq", None, None, None)])
    got = by_id(language_id.identify(docs, language_id.fit(docs.where("doc_id % 3 <> 1 or doc_id < 30"), dims=1024, clusters=2)))
    assert all(got[i].lang_pred == lang and 0 < got[i].score <= 1 and not got[i].rejected for i, _, lang, *_ in rows)
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (900, 901, 902))
    assert got[903].rejected and got[903].lang_pred in kinds
    model = language_id.fit(docs, dims=1024, clusters=2)
    assert language_id.identify(docs.limit(0), model).count() == 0
    long = "abcd dcba bacd " * 40_000
    again = language_id.identify(table(spark, "score", [(1, long, None, None, None), (1, long, None, None, None), (2, "wxyz " * 9, None, None, None)]), model).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in again) == [(1, "aa"), (1, "aa"), (2, "bb")] and len({r.score for r in again if r.doc_id == 1}) == 1
    tie = language_id.CentroidModel(["aa", "bb"], np.array([0, 1]), np.ones((64, 2), np.float32) / 8, np.zeros((2, 7)), np.ones((2, 64), bool), np.ones(64))
    assert language_id.identify(table(spark, "x", [(1, "abc", None, None, None)]), tie).first().lang_pred == "aa"
    nothing = by_id(language_id.identify(docs, language_id.fit(docs.limit(0))))
    assert {r.lang_pred for r in nothing.values()} == {"und"}


def test_language_id_keeps_labelled_texts_and_rejects_foreign_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    polish = "Wszyscy ludzie rodza sie wolni i rowni pod wzgledem swej godnosci i swych praw. Sa oni obdarzeni rozumem i sumieniem i powinni postepowac wobec innych w duchu braterstwa. "
    finnish = "Kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu jarki ja omatunto, ja heidan on toimittava toisiaan kohtaan veljeyden hengessa. "
    noise = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz ", k=600))
    odd = spark.createDataFrame([(-1, "Это другой язык и его слова", None), (-2, "漢字かな交じり文のとても長い文章です", None), (-3, None, None), (-4, polish * 2, None), (-5, finnish * 2, None), (-6, noise, None), (-7, "aeiou " * 50, None)], docs.schema)
    got = language_id.identify(docs.union(odd), language_id.fit(docs)).where("rejected").collect()
    assert sorted(r.doc_id for r in got) == [-7, -6, -5, -4, -3, -2, -1]


def test_language_id_learns_from_repeated_texts(spark):
    few = ["kilo lima kilolima", "mike nova mikenova", "oska papa oskapapa"]
    rows = [(i, few[i % 3], "aa", None, None) for i in range(3000)] + [(5000 + i, "éüöß üöéß ßéüö", "bb", None, None) for i in range(2000)]
    model = language_id.fit(table(spark, "x", rows), dims=1024)
    assert model.langs == ["aa", "bb"]
    got = by_id(language_id.identify(table(spark, "x", rows), model))
    assert all(got[i].lang_pred == lang and not got[i].rejected for i, _, lang, *_ in rows)


def test_quality(spark):
    rng = random.Random(4)
    rows = [(i, text(40) if i % 4 else " ".join([w := rng.choice(WORDS)] * 40) + w, None, None, None) for i in range(240)]
    docs = table(spark, "score", [*rows, (900, None, None, None, None), (901, "", None, None, None), (902, text(20_000), None, None, None)])
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 240, 1) if i % 5] + [(None, 1), (5000, 0), (3, None)], "doc_id long, quality int")
    repeats = by_id(quality.score(docs, *quality.fit(docs, labels, again=True), again=True))
    assert np.mean([(repeats[i].score >= 0.5) == (i % 4 > 0) for i in range(0, 240, 5)]) > 0.9
    rows = [(i, f"{text(20)} {'well' if i % 4 else 'badly'} made thing {text(20)}", None, None, None) for i in range(240)]
    docs = table(spark, "score", [*rows, (900, None, None, None, None), (901, "", None, None, None), (902, text(20_000), None, None, None)])
    got = by_id(quality.score(docs, *quality.fit(docs, labels)))
    assert np.mean([(got[i].score >= 0.5) == (i % 4 > 0) for i in range(0, 240, 5)]) > 0.9
    assert got[900].score == got[901].score and 0 <= got[900].score <= 1
    assert all(r.score == 0.5 for r in quality.score(docs, *quality.fit(docs, labels.limit(0))).collect())
    assert quality.score(docs.limit(0), *quality.fit(docs.limit(0), labels)).count() == 0
    twice = docs.union(docs)
    again = quality.fit(twice, labels)
    assert {(r.doc_id, r.n) for r in quality.score(twice, *again).groupBy("doc_id").agg(F.count_distinct("score").alias("n")).collect()} == {(i, 1) for i in got}
    assert len(quality.fit(twice, labels, max_rows=10)[0]) == 1 << 18 and not quality.fit(docs, labels, max_bytes=0)[0].any()


def test_quality_features_by_hand():
    import pyarrow as pa

    from roadloom.llm.common import chunks

    (_, _, buf, offs), = chunks(pa.array(["A b  a B a", "", "x"]))
    rows = [np.sort(x) for _, _, x in quality._features(buf, offs, 18)]
    n = np.sort([3, 2, 2, 2, 2, 1])  # a, b, "a b", "b a", "a b a" and "b a b"
    assert np.allclose(rows[0], 8 * n / np.sqrt((n**2).sum())) and len(rows[1]) == 0 and list(rows[2]) == [8.0]


def test_license_scan(spark):
    docs = table(spark, "License", [(1, "x y z\nReleased under the MIT license.\nq", None, None, None), (2, "licensed under CC BY-NC 4.0", None, None, None), (3, None, None, None, None), (4, "", None, None, None), (5, text(5000), None, None, None), (6, "Released under the new MIT License.", None, None, None)])
    got = by_id(licenses.scan(docs))
    assert [got[i].license for i in range(1, 7)] == ["MIT", "CC-BY-NC-4.0", None, None, None, None]
    assert got[1].dice == 1.0 and [(m.license, m.line) for m in got[1].matches] == [("MIT", 1)]
    for i, t in ((6, "Released under the new MIT License."), (1, "Released under the MIT license.")):
        a, b = licenses.bigrams(t), licenses.bigrams("Released under the MIT License.")
        assert math.isclose(2 * len(a & b) / (len(a) + len(b)), {6: 6 / 9, 1: 1.0}[i])


def test_license_scan_of_repeats_ties_other_templates_and_no_rows(spark):
    docs = [(1, "alpha beta gamma", None, None, None), (1, "alpha beta gamma", None, None, None), (2, "x alpha beta gamma y\nalpha beta gamma", None, None, None), (3, "alpha", None, None, None), (4, "alpha beta " * 3000, None, None, None)]
    got = licenses.scan(table(spark, "matches", docs), {"B": ["alpha beta gamma"], "A": ["Alpha, beta: gamma!"], "C": ["alpha"]}).collect()
    by = {r.doc_id: r for r in got}
    assert sorted(r.doc_id for r in got) == [1, 1, 2, 3, 4]
    assert (by[1].license, by[1].dice, [(m.license, m.line) for m in by[1].matches]) == ("A", 1.0, [("A", -1), ("B", -1)])  # of equals the first name
    assert (by[2].license, [(m.license, m.line, m.dice) for m in by[2].matches if m.license == "A"][0]) == ("A", ("A", 1, 1.0))
    assert (by[3].license, by[4].license) == ("C", None)
    assert licenses.scan(table(spark, "x", [])).count() == 0


def test_license_lines_against_brute_force():
    rng = random.Random(11)
    words = "alpha beta gamma delta epsilon".split()
    templates = {f"L{i}": [" ".join(rng.choices(words, k=rng.randint(1, 6)))] for i in range(5)}
    known = licenses._Known(templates)
    for _ in range(80):
        doc = "\n".join(" ".join(rng.choices(words, k=rng.randint(0, 7))) for _ in range(rng.randint(1, 4)))
        got = {(m["license"], m["line"]): m["dice"] for m in licenses._match(doc, known, 0.8)["matches"]}
        lines = doc.split("\n")
        for at, line in [(-1, doc.replace("\n", " ")), *(enumerate(lines) if len(lines) > 1 else [])]:
            own = line.split()
            a = set(zip(own, own[1:], strict=False)) if len(own) != 1 else {(own[0],)}
            for name, (t,) in templates.items():
                w = t.split()
                b = set(zip(w, w[1:], strict=False)) if len(w) != 1 else {(w[0],)}
                dice = 2 * len(a & b) / (len(a) + len(b)) if a else 0
                if dice >= 0.8:
                    assert got[name, at] >= dice - 1e-12, (doc, name, at)


def _wrapped(t, width):
    w = t.split()
    return "\n".join(" * " + " ".join(w[i : i + width]) for i in range(0, len(w), width))


def test_licenses_in_bodies_headers_wrapped_and_inside_paragraphs(spark):
    t, around = licenses.TEMPLATES, " ".join(f"wort{i}" for i in range(60))
    bodies = {n: x[-1] for n, x in t.items() if len(x[-1]) > 600}
    assert {"MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0"} <= bodies.keys()
    cases = [(n, f"{around}\n\nCopyright (c) 2020 Someone. All rights reserved.\n\n{_wrapped(x, 9)}\n{around}") for n, x in bodies.items()]
    cases += [(n, f"{around}. {t[n][2]} {around}") for n in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0")]
    cases += [(n, f"{around}\n{_wrapped(t[n][0], 5)}\n{around}") for n in ("MPL-2.0", "GPL-2.0", "GPL-3.0", "CC-BY-SA-4.0")]
    cases += [(n, f"{around} {t[n][0]} {around}") for n in sorted(t)]
    cases += [(None, f"{around} and/or modify it under the terms of the agreement {around}"), (None, around)]
    got = by_id(licenses.scan(table(spark, "Dice", [(i, x, None, None, None) for i, (_, x) in enumerate(cases)])))
    assert [got[i].license for i in range(len(cases))] == [n for n, _ in cases]


def test_license_windows_are_the_best_of_all():
    rng = random.Random(8)
    for _ in range(60):
        template, doc = " ".join(rng.choices("abcde", k=rng.randint(4, 9))), rng.choices("abcdefg", k=60)
        n, own = len(template.split()) - 1, licenses.bigrams(template)
        spans = [licenses.bigrams(" ".join(doc[i : j + 1])) for i in range(60 - n) for j in range(i + n, min(i + int(n * 1.5), 59) + 1)]
        best = max(2 * len(own & s) / (len(own) + len(s)) for s in spans)
        got = licenses._match(" ".join(doc), licenses._Known({"L": [template]}), 0.8)["dice"]
        assert math.isclose(got, best if best >= 0.8 else 0.0)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, ["en", "fr", None][i % 3], s, len(t or "")) for i, t, _, s, _ in ROWS] + [(i, t, "en", "a", len(t)) for i, t in DIRTY]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {i: t for i, t, *_ in rows}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        nxt = spark.read.parquet(f"{tmp_path}/{k}")
        ids = [r.doc_id for r in nxt.collect()]
        if k == 0:  # texts without a letter are rejected, and no other
            kept = {i: t for i, t in kept.items() if re.search(r"[^\W\d_]", t or "")}
            assert set(ids) <= set(kept) and len(ids) >= 0.9 * len(kept)
            kept = {i: kept[i] for i in ids}
        elif k == 1:
            kept = {i: t for i, t in kept.items() if linked_all[i][1] == i} if (linked_all := linked(list(kept.items()), 5, 80, 100)) else kept
            assert sorted(ids) == sorted(kept)
        elif k == 2:
            hits = {i: expected_hits(ITEMS, t, 13) for i, t in kept.items()}
            kept = {i: t for i, t in kept.items() if i not in hits or not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])}
            assert sorted(ids) == sorted(kept)
        elif k == 3:
            mixed = by_id(mixing.mix(docs))
            assert sorted(ids) == sorted(i for i, r in mixed.items() for _ in r.passes) and nxt.columns == docs.columns
            order = [r.doc_id for r in out.collect()]  # partitions are in order of position, and rows within them
            places = sorted((p["position"], i, p["pass"]) for i, r in mixed.items() for p in r.passes)
            assert order == [i for _, i, _ in places]
        else:
            size = defaultdict(int)
            for r in nxt.collect():
                size[r.shard] += r.size
            assert sorted(ids) == sorted(r.doc_id for r in docs.collect()) and set(size) <= set(range(8))
            assert sum(size.values()) == sum(len((kept[i] or "").encode()) + 1 for i in ids)
        docs = nxt
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_of_no_documents_and_of_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    rows = [(i, f"{text(30)} {i}", "en", "a", 1, "mine", 7, "mine") for i in range(40)]
    spark.createDataFrame(rows, schema + ", Items string, taken int, Rejected string").write.parquet(f"{tmp_path}/b/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/b/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{tmp_path}/b")
        assert out.columns == docs.columns and {(r["Items"], r.taken, r["Rejected"]) for r in out.collect()} == {("mine", 7, "mine")}


def test_results_on_the_small_tables(spark):
    """Held-out accuracy and coverage of the registered queries' own models."""
    from roadloom.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    told = queries.op1_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert told.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.9
    marked = queries.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert marked.select(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.75


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op4_sharding", "op5_decontaminate", "op8_mixing", "op6_chat_format", "op9_jaccard_join"])
def test_queries_give_the_rows_of_their_sql(spark, name):
    import duckdb

    from roadloom.llm import queries

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = queries.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want)
