"""Structure repair, cover trees and spelling tries against brute force, on odd rows, split groups and empty tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from evalloom.llm import covertree, repair, spelling

SF = "/root/testdata/sf0.001"


def _sorted(rows):
    return sorted(map(tuple, rows), key=str)


# --- op11 -----------------------------------------------------------------------------------------------------------

NEXT = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def edits(rows, faults):
    """(cost, audit, repaired) by search over an automaton of role initials, row by row; no gaps, sums or minima."""

    @lru_cache(None)
    def best(i, q, inserted):
        found = [(0, "", ())] if i == len(rows) and q in "0a" else []

        def go(cost, letter, rest, item=()):
            if rest:
                found.append((cost + rest[0], letter + rest[1], item + rest[2]))

        if inserted < 2:
            for z in "ua":
                if (q, z) in NEXT:
                    go(2, "I", best(i, NEXT[q, z], inserted + 1), ((NAMES[z], ""),))
        if i < len(rows):
            role, text = rows[i]
            go(3, "D", best(i + 1, q, 0))
            if faults[i] not in ("blank", "duplicate"):
                cut = int(faults[i] == "truncated")
                if role[:1] and (q, role[:1]) in NEXT:
                    go(cut, "K", best(i + 1, NEXT[q, role[:1]], 0), ((role, text),))
                for z in "ua":
                    if (q, z) in NEXT:
                        go(2 + cut, "R", best(i + 1, NEXT[q, z], 0), ((NAMES[z], text),))
        return min(found, default=None, key=lambda x: x[:2])

    return best(0, "0", 0)


def repaired_by_search(rows):
    text = lambda v: " " if v is None else str(v)
    held: dict = {}
    for conv, turn, role, said in rows:
        mine = held.setdefault(conv, [])
        code = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, said = text(role), text(said)
        if code == 0:
            continue
        said = "" if code == 1 else re.sub("[.!?]", "", said) if code == 2 else said
        mine += [(turn, "user" if code == 4 else role, said)] * (2 if code == 3 else 1)
    out = []
    for conv, mine in held.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, seen, faults = [r[0] for r in mine if r[0] is not None], set(), []
        for _, role, said in mine:
            marks = re.findall(r"[^\x20\x09-\x0D]", said)
            faults.append("blank" if not marks else "duplicate" if (role, said) in seen else "" if marks[-1] in ".!?" else "truncated")
            seen.add((role, said))
        cost, audit, kept = edits([r[1:] for r in mine], faults)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        ))
    return _sorted(out)


@pytest.fixture(scope="module")
def talks():
    rng, rows = random.Random(5), []
    for c in range(150):
        for t in range(rng.choice([1, 2, 3, 5, 9, 14, 30])):
            rows.append((None if c == 7 else c, rng.choice([None, t, t, t, t + 3]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "u"]), rng.choice(["hi.", "ok", "Yes!", "  ", "\t", None, f"long {t}.", "é? \n", "x "])))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"most": 4, "chunk": 3}, {"most": 0, "chunk": 1}, {"most": 20, "chunk": 7, "chunk_bytes": 20}])
def test_repair_equals_search(spark, talks, sizes):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").repartition(3)
    assert _sorted(repair.repair(df, **sizes).collect()) == repaired_by_search(talks)


def test_repair_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert _sorted(repair.repair(df).collect()) == repaired_by_search([tuple(r) for r in df.collect()])


def test_repair_known_cases():
    rows = lambda *x: [(r, t) for r, t in x]
    assert repair.solved(rows(("user", "a."), ("assistant", "b.")))["audit"] == "KK"
    assert repair.solved(rows(("assistant", "b.")))["audit"] == "IK"
    assert repair.solved(rows(("system", "s.")))["audit"] == "D"
    # deleting the second costs 3, an insert between them 2 and one more at the end
    assert repair.solved(rows(("user", "a."), ("user", "b."), ("assistant", "c.")))["cost"] == 2
    assert repair.solved([]) == {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def test_repair_odd_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(none).collect() == []
    # extra columns with the operator's own names
    df = spark.createDataFrame([(1, 1, "user", "a.", 5, True, "x"), (1, 2, "assistant", "b." * 100_000, 6, False, "y")], "conv_id long, turn long, role string, text string, code int, alive boolean, `conv.x` string")
    want = repaired_by_search([tuple(r)[:4] for r in df.collect()])
    assert _sorted(repair.repair(df).collect()) == want
    assert _sorted(repair.repair(df, most=0, chunk=1).collect()) == want


# --- op12 -----------------------------------------------------------------------------------------------------------


def linked_by_all_pairs(rows):
    usable = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2])]
    out = [(r[0], 0, r[0], r[0] is not None) for r in rows if r not in usable]
    n, x = len(usable), [np.array(r[2], float) for r in usable]
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and usable[i][1] == usable[j][1] and len(x[i]) == len(x[j]):
                near[i, j] = x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.93
    part = np.arange(n)
    while True:
        new = np.array([min(part[near[i]].min(initial=n), part[i]) for i in range(n)], int)
        if (new == part).all():
            break
        part = new
    least: dict = {}
    for i in range(n):
        if usable[i][0] is not None:
            least[part[i]] = min(least.get(part[i], 1 << 60), usable[i][0])
    return _sorted(out + [(usable[i][0], int(near[i].sum()), least.get(part[i]), usable[i][0] is not None and usable[i][0] == least.get(part[i])) for i in range(n)])


@pytest.mark.parametrize(("shard", "pack"), [(16_384, 16_384), (100, 40), (25, 10)])
def test_cover_tree_equals_all_pairs(spark, monkeypatch, shard, pack):
    monkeypatch.setattr(covertree, "PACK", pack)
    rng = np.random.default_rng(3)
    base, rows = rng.normal(size=(12, 16)), []
    for i in range(400):
        v = base[rng.integers(12)] if i % 3 else rng.normal(size=16)
        rows.append((int(i), int(rng.integers(3)), [float(np.float32(z)) for z in v * rng.choice([1, 7.5]) + rng.normal(size=16) * rng.choice([0, 0.01, 0.1, 0.3, 0.5])]))
    rows += [(0, 1, rows[5][2]), (None, 1, rows[5][2]), (900, None, rows[5][2]), (901, 1, None), (902, 1, [0.0] * 16), (903, 1, [float("nan")] + [1.0] * 15), (904, 1, [None] + [1.0] * 15), (905, 2, [1.0, 2.0]), (906, 2, [1.0, 2.01]), (907, 2, [-0.0, 2.0]), (908, 2, [0.0, 2.0]), *[rows[8]] * 70]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4)
    assert _sorted(covertree.near(df, shard=shard).collect()) == linked_by_all_pairs(rows)


def test_cover_tree_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding")
    assert _sorted(covertree.near(df).collect()) == linked_by_all_pairs([tuple(r) for r in df.collect()])


def test_cover_tree_levels():
    """Centres of a net are further apart than its radius, radii are true, and every vector is in one slice."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    tree = covertree.CoverTree(x / np.linalg.norm(x, axis=1)[:, None])
    assert sorted(tree.order.tolist()) == list(range(2000))
    todo = [tree.root]
    while todo:
        node = todo.pop()
        for c, r, a, b, sub in zip(node.centre, node.radius, node.low, node.high, node.node, strict=True):
            inside = tree.order[a:b]
            assert c in inside
            far = np.linalg.norm(tree.unit[inside] - tree.unit[c], axis=1).max()
            assert abs(far - r) < 1e-7
            if sub:
                assert sub.low[0] == a and sub.high[-1] == b
                todo.append(sub)


def test_cover_tree_dense_group_is_not_listed(spark):
    """Twenty thousand vectors within the reach: two hundred million links, counted by bounds."""
    rng = np.random.default_rng(2)
    x = 1 + rng.normal(size=(20_000, 8)) * 0.02
    v = covertree.Vectors(np.arange(20_000), np.ones(20_000, np.int64), x)
    found = covertree.traverse(v, None, 0.93)
    assert (found.links[0] == 19_999).all()


def test_cover_tree_odd_tables(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<double>")
    assert covertree.near(none).collect() == []
    df = spark.createDataFrame([(1, 3, [1.0, 0.0], 9, 8), (2, 3, [1.0, 0.1], 9, 8), (3, 4, [1.0, 0.1], 9, 8)], "vec_id long, label int, embedding array<double>, cid int, many int")
    assert _sorted(covertree.near(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


# --- op13 -----------------------------------------------------------------------------------------------------------


def near_words(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def forms_by_all_pairs(docs):
    count: Counter = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            count[low] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    of = {}
    for w, n in words.items():
        near = [x for x in words if near_words(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        of[w] = (best if best and words[best] >= 10 * n else None, n, len(near))

    def root(w):
        while of[w][0]:
            w = of[w][0]
        return w

    return _sorted((w, f, root(w), n, k, words[f] if f else None) for w, (f, n, k) in of.items())


def test_spelling_equals_all_pairs(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abbà") for _ in range(rng.randint(7, 10))) for _ in range(60)]
    docs = [(None, "Straße ÀÉÎÕÜÝ÷×ÿ " * 3), (1, None), (2, ""), (3, "a" * 5000 + " " + "a" * 4999), (3, "a" * 5000 + "_" + "a" * 4999), (4, "Aaaaaaaa1aaaaaaa aaaaaaaaa")]
    for i in range(300):
        said = []
        for _ in range(60):
            w = rng.choice(base[: rng.choice([3, 10, 60])])
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abàz") + w[k:], w[:k] + rng.choice("abàz") + w[k + 1 :], w.title()])
            said.append(w)
        docs.append((i + 10, rng.choice([" ", ", ", "-"]).join(said)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = forms_by_all_pairs(docs)
    assert any(w[1] for w in want) and any(w[1] and w[2] != w[1] for w in want)
    assert _sorted(spelling.variants(df).collect()) == want
    # several shards and rounds
    assert _sorted(spelling.variants(df, size=17, most=2000).collect()) == want


def test_spelling_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert _sorted(spelling.variants(df).collect()) == forms_by_all_pairs([tuple(r) for r in df.collect()])


def test_spelling_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(none).collect() == []
    df = spark.createDataFrame([(1, "wordword wordword", "x", 3), (2, "wordwort wordwort", "y", 4)], "doc_id long, text string, word string, n int")
    assert _sorted(spelling.variants(df).collect()) == [("wordword", None, "wordword", 2, 1, None), ("wordwort", None, "wordwort", 2, 1, None)]


def test_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)] + [("a", "w3")], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(f"w{i}", "w9") for i in range(9)} | {("a", "w9")}


def test_rounds_of_roots_are_few_files(spark):
    """In a session of many partitions that aren't joined, a round has no file for each of them."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(held, ("40", "false", "-1"), strict=True):
        spark.conf.set(k, v)
    try:
        forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(0, 2000) if i % 5 < 4], "word string, form string")
        got = spelling.roots(forms)
        assert len(got.inputFiles()) == 1
        assert {tuple(r) for r in got.collect()} == {(f"w{i}", f"w{i - i % 5 + 4}") for i in range(0, 2000) if i % 5 < 4}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_long_words_fill_packs_and_batches():
    """Letters close a pack or a batch of counts as well as words do; nothing is lost or cut."""
    words = ["".join(chr(97 + (i + k) % 26) for k in range(500)) for i in range(20)] + ["a" * 5000, "short", "shorter"]
    got = list(spelling.packs([pa.RecordBatch.from_pydict({"word": words})], words=8, letters=2000))
    assert [w for b in got for w in b.column("word").to_pylist()] == words
    sizes = [[len(w) for w in b.column("word").to_pylist()] for b in got]
    assert all(len(x) <= 8 and (sum(x) <= 2000 or len(x) == 1) for x in sizes)
    texts = pa.RecordBatch.from_pydict({"doc_id": list(range(len(words))), "text": [f"{w} {w}" for w in words]})
    out = list(spelling.counted([texts], letters=2000))
    assert all(sum(map(len, b.column("word").to_pylist())) <= 7000 for b in out)
    total: Counter = Counter()
    for b in out:
        total.update(dict(zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True)))
    want: Counter = Counter()
    for b in spelling.counted([texts]):
        want.update(dict(zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True)))
    assert len(out) > 4 and total == want and sum(want.values()) == 2 * 22


def test_pairs_of_dense_words_come_in_blocks():
    """All words of three letters over 12: every one has 33 neighbours, which are reduced a block at a time."""
    words = sorted("".join(x).encode() for x in itertools.product("abcdefghijkl", repeat=3))
    trie = spelling.Trie.unpacked(spelling.Trie(words, np.ones(len(words), np.int64)).packed())
    sizes = np.full(len(words), 3)
    letters, starts = np.frombuffer(b"".join(words) + b"\0", np.uint8), np.cumsum(sizes) - sizes
    near, blocks = np.zeros(len(words), np.int64), 0
    block = spelling.BLOCK
    try:
        spelling.BLOCK = 512
        for w, _ in spelling.gathered(spelling.neighbours(trie, letters, starts, sizes), 5000):
            assert len(w) < 5000 + 512
            near += np.bincount(w, minlength=len(words))
            blocks += 1
    finally:
        spelling.BLOCK = block
    assert blocks > 5 and (near == 33).all()


# --- mended parts of earlier operators ------------------------------------------------------------------------------


def test_dense_fingerprints_link_exactly():
    """Fingerprints around one centre, which no vantage point divides, equal comparing all pairs."""
    from evalloom.llm import simhash

    rng = np.random.default_rng(4)

    def around(n):
        out = np.full(n, 0x0123456789ABCDEF, np.uint64)
        for i in range(n):
            for b in rng.choice(64, rng.integers(3, 8), replace=False):
                out[i] ^= np.uint64(1) << np.uint64(b)
        return np.unique(out)

    x = around(6000)
    forest = simhash.Forest(len(x))
    for i in range(len(x)):
        near = np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 2)
        forest.join(near, np.full(len(near), i))
    a, b = simhash._links(x[::2], x[1::2], 2)
    mine = simhash.Forest(len(x))
    mine.join(np.searchsorted(x, a), np.searchsorted(x, b))
    # links between two visitors belong to their own shard
    visitors = np.zeros(len(x), bool)
    visitors[1::2] = True
    want = simhash.Forest(len(x))
    for i in range(0, len(x), 2):
        near = np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 2)
        want.join(near, np.full(len(near), i))
    every = np.arange(len(x))
    both = simhash.Forest(len(x))
    found = list(simhash.dense_pairs(x, every, x, every))
    for i, j in found:
        assert (np.bitwise_count(x[i] ^ x[j]) <= 2).all()
        both.join(i, j)
    assert (both.root(every) == forest.root(every)).all()
    got, expected = mine.root(every), want.root(every)
    # what must be linked is, and nothing else
    assert len(np.unique(got)) == len(np.unique(expected)) and len(np.unique(np.stack([got, expected]), axis=1).T) == len(np.unique(got))


def test_two_hundred_thousand_dense_fingerprints_in_seconds():
    import time

    from evalloom.llm import simhash

    rng = np.random.default_rng(4)
    x = np.zeros(200_000, np.uint64)
    for _ in range(7):
        x ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    x, began = np.unique(x), time.time()
    a, _ = simhash._links(x, np.zeros(0, np.uint64), 2)
    assert len(a) > 50_000 and time.time() - began < 60


def test_shared_folder_without_a_setting(tmp_path):
    from evalloom.llm.common import shared_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "local[2]"

    assert shared_dir(Session()) == shared_dir(Session())


def test_seeds_seen_only_in_clean_rows_do_not_count():
    from evalloom.llm import toxicity

    seeds = toxicity.seed_features()
    weights, _ = toxicity._lexicon({}, [], 0.0, {seeds[0]: -1.0, seeds[1]: 2.0})
    assert seeds[0] not in weights and weights[seeds[1]] == 2.0 and weights[seeds[2]] == toxicity.SEED


def test_searches_with_repeated_ids(spark):
    """Five rows of one id with different vectors: each gets 20 results, and the others of its id are candidates."""
    from collections import defaultdict

    from evalloom.llm import multiindex, permutation

    rng = np.random.default_rng(8)
    x = rng.normal(size=(45, 12))
    ids = [20] * 5 + list(range(101, 120)) + list(range(121, 140)) + [160, 160]
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=False)] + [(20, x[0].tolist()), (7, [1.0, 2.0]), (40, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    # sets of results by query row can't be told apart by id, so compare the multiset of result lists
    once = list({(i, tuple(v)) for i, v in rows})

    def lists(far, of):
        out = []
        for q, v in once:
            if q % 20 == 0:
                near = sorted((far(v, w), i) for i, w in once if (i, w) != (q, v) and len(w) == len(v))[:20]
                out += [(q, k + 1, i, of(d)) for k, (d, i) in enumerate(near)]
        return sorted(out)

    dot = lists(lambda a, b: -float(np.dot(a, b)), lambda d: round(-d, 9))
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in permutation.nearest(df).collect()]
    assert sorted(got) == dot
    bits = lists(lambda a, b: sum((s > 0) != (t > 0) for s, t in zip(a, b, strict=True)), int)
    found = [(r.query_id, r["rank"], r.vec_id, r.distance) for r in multiindex.nearest(df).collect()]
    assert sorted(found) == bits
    per = defaultdict(int)
    for q, *_ in found:
        per[q] += 1
    assert per[20] == 100 and per[40] == 1


def test_words_of_the_documents_lower_guess_costs(spark):
    import math

    from evalloom.llm import secrets

    before = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    rows = [(i, f"{w} zephyrous and more") for i, w in enumerate(before)]
    # copies of one passage hold a password that must not become a word
    rows += [(100 + i, "the credentials: Zqxjkvbpmwtr are here") for i in range(60)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ranks = secrets.fit(docs)
    assert "zephyrous" in ranks and "zqxjkvbpmwtr" not in ranks
    bits = {w: set() for w in ("zephyrous", "and")}
    for _, t in rows:
        words = (t or "").split()
        for a, b in zip(words, words[1:], strict=False):
            if b in bits:
                bits[b].add(zlib.crc32(a.encode()) & 63)
    assert {w for w in bits if len(bits[w]) >= secrets.LEAST_CONTEXTS} == {w for w in bits if w in ranks}
    assert abs(secrets.guess_cost("Zephyrous", ranks) - (math.log10(ranks["zephyrous"] + 1) + 0.3)) < 1e-9 < secrets.LEAST_COST < secrets.guess_cost("zephyrous")
    found = {r.doc_id: r for r in secrets.find(docs.union(spark.createDataFrame([(1000, "auth: zephyrous")], "doc_id long, text string"))).collect()}
    assert found[1000].n_guess == 0 and found[100].n_guess == 1
    for text in ("auth: authentication module", "credentials: provided by admin", "access key: unavailable", "bearer is carrying", "auth: translations"):
        assert secrets.scan(text) == []


def rules_by_search(text):
    """Licences of a text of one-line sentences: each pattern tried on each sentence, each rule at each place."""
    from evalloom.llm import licenses

    names = []
    for line in text.split("\n"):
        for part in re.split(r"(?<!\b[vV])[.!?](?=\s|$)", line):
            if not part.strip():
                continue
            words = " ".join(re.findall(r"[^\W_]+", part.lower()))
            name = next((n for n, p in licenses.SENTENCES.items() if re.fullmatch(p, words)), "?")
            if name in licenses._REFERENCES:
                at = min((words.find(k) for k in ("under", "cc0", "creative commons", "public domain", "wtfpl", "cddl", "gnu", "mozilla", "eclipse", "artistic", "common development") if k in words), default=0)
                if any(f" {w} " in f" {' '.join(words[:at].split()[-8:])} " for w in ("not", "never", "don t", "no longer", "isn t")):
                    name = "?"
            names.append(name)
    used, found = set(), {}
    for licence, rule in licenses.RULES:
        for i in range(len(names)):
            places, at = [], i
            for k, want in enumerate(rule):
                gap = 0
                while k and at < len(names) and (at in used or names[at] != want) and (at in used or names[at] in ("?", "copyright")) and gap < licenses.GAP:
                    at, gap = at + 1, gap + 1
                if at >= len(names) or at in used or names[at] != want:
                    places = []
                    break
                places.append(at)
                at += 1
            if places:
                used |= set(places)
                found[licence] = min(found.get(licence, i), i)
    return sorted(found, key=lambda x: (found[x], x))


def test_rules_equal_a_search():
    from evalloom.llm import licenses

    rnd = random.Random(6)
    known = [
        "Licensed under the BSD 3-Clause License.", "Released under CC BY-SA 3.0.", "Licensed under CC BY-ND 4.0", "It is licensed under the WTFPL.", "This is free and unencumbered software released into the public domain.", "We do not use cc0 here.",
        "This is not licensed under the MIT License.", "Released under the MIT License.", "Copyright (c) 2020 A. Body", "All rights reserved.", "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Redistributions of source code must retain the notice.", "Redistributions in binary form must reproduce it.", "Neither the name of it may be used to endorse or promote products.", "This software is provided by us as is and any express or implied warranties are disclaimed.",
        "Some words.", "Others, too!", "Licensed under Creative Commons Attribution-NonCommercial-ShareAlike 2.5", "Licensed under the Apache License, Version 2.0", "You may not use this file except in compliance with the License.", "Made under the CDDL 1.1.", "The Artistic License 2.0 holds.",
    ]
    seen = set()
    for _ in range(400):
        text = "\n\n".join(rnd.choice(known) for _ in range(rnd.randrange(1, 12)))
        got = licenses.scan(text)[1]
        assert got == rules_by_search(text), text
        seen |= set(got)
    assert {"BSD-3-Clause", "CC-BY-SA-3.0", "CC-BY-ND-4.0", "WTFPL", "Unlicense", "CC-BY-NC-SA-2.5", "CDDL", "Artistic", "MIT", "Apache-2.0", "proprietary"} <= seen and "CC0-1.0" not in seen


def test_versions_of_families(spark):
    from evalloom.llm import licenses

    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n"
    rows = [(1, gpl), (2, "Made available under the terms of the Eclipse Public License 2.0 there"), (3, "Made under the CDDL 1.1."), (4, None), (5, "Licensed under the MIT License"), (6, gpl.replace("3", "2")), (7, "This is not licensed under\nthe MIT License")]
    got = {r.doc_id: (r.licenses, r.versions) for r in licenses.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("GPL-family", "GPL-3.0-or-later"), 2: ("EPL", "EPL-2.0"), 3: ("CDDL", "CDDL-1.1"), 4: ("", ""), 5: ("MIT", ""), 6: ("GPL-family", "GPL-2.0-or-later"), 7: ("", "")}
