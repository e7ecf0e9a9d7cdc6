"""Spelling variants: each word's neighbours at edit distance one, its form and the root of its chain of forms.

1. Words of all texts with their counts: tasks add up before the shuffle.
2. The sorted vocabulary is cut into ranges of ``SHARD`` words; each becomes a compact trie (nodes in level order, so that
   the children of a node lie side by side: a label, a first child and a word number for each node).
3. Shards are broadcast, ``BROADCAST`` bytes at most at a time: a larger vocabulary takes several rounds. In a task the
   automata of a pack of words (words within one edit: position in the word, edits used) go through every shard depth-first;
   accepting states give the neighbours. A pack's states are expanded together as arrays, and the stack holds blocks of
   them. An edit at the end of equal letters counts once, so no neighbour is met twice.
4. A word's neighbours are reduced in its task to their number and the best one; rounds are reduced by one aggregate.
5. Roots by pointer doubling over the forms; a form has ten times the count of its word, so chains are short.

Defined results: null and empty texts have no words; a null doc_id is written as the empty text before the colon; repeated
rows count again; words of any length take part; a table without words gives an empty result; a word without neighbours has
``n_near`` 0, no form, and is its own root.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, slices, texts, written

LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
DAMAGED = 31  # one run in so many loses a code point
SHARD = 50_000  # words in a trie shard, about
LETTERS = 4 << 20  # and letters, at most by more than a word
BROADCAST = 96 << 20  # bytes of shards that are broadcast together; one shard has some 2 MB
PACK = 4096  # words whose automata go through a shard together
BLOCK = 1 << 16  # states that are expanded together
HITS = 1 << 20  # neighbours of a pack in a shard that are reduced together, about
HELD = 200_000  # different words that a task adds up before they go out
HELD_LETTERS = 16 << 20  # and their letters, at most by more than a text's
ROWS = 1 << 14  # forms a task of a round of pointer doubling

_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")  # shorter runs give no word


def words_of(text: str, doc_id: int | None) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text, for the words that are long enough."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    low = text.encode("utf-8", "replace").lower().decode()  # A-Z only
    for run, n in Counter(_RUN.findall(low)).items():
        h = zlib.crc32(run.encode(), start)
        if h % DAMAGED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        yield run, n


def counted(batches: Iterator[pa.RecordBatch], words: int = HELD, letters: int = HELD_LETTERS) -> Iterator[pa.RecordBatch]:
    """word, n of a task's texts, added up within each batch; few very long words fill one as many short ones do."""
    held: Counter[str] = Counter()
    size = 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for b in slices(batches, "text", 8 << 20):
        for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b.column("text")), strict=True):
            for word, n in words_of(text, doc_id):
                if word not in held:
                    size += len(word)
                held[word] += n
            if len(held) > words or size > letters:
                yield out()
                held, size = Counter(), 0
    if held:
        yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: all words with their counts of ``LEAST_COUNT`` and more."""

    counts = docs.select("doc_id", "text").mapInArrow(lambda batches: counted(batches), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Trie:
    """A compact trie of sorted, different words in Latin-1.

    Nodes are numbered level by level; ``first[v]:first[v + 1]`` are the children of v, by label; ``word[v]`` is the number
    of the word that ends in v, or -1.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.letters, self.ends, self.n = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes), counts
        starts = self.ends - sizes
        live, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        labels, ups, total = [np.zeros(1, np.uint8)], [np.zeros(1, np.int64)], 1
        last = np.zeros(len(words), np.int64)
        depth = 0
        while len(live):
            c = self.letters[starts[live] + depth]
            # sorted words: equal prefixes lie side by side
            new = np.concatenate([[True], (c[1:] != c[:-1]) | (node[1:] != node[:-1])])
            labels.append(c[new])
            ups.append(node[new])
            node = total + np.cumsum(new) - 1
            total += int(new.sum())
            depth += 1
            ended = sizes[live] == depth
            last[live[ended]] = node[ended]
            live, node = live[~ended], node[~ended]
        self.label = np.concatenate(labels)
        self.first = np.searchsorted(np.concatenate(ups)[1:], np.arange(total + 1)).astype(np.int32) + 1
        self.word = np.full(total, -1, np.int32)
        self.word[last] = np.arange(len(words))

    def packed(self) -> bytes:
        head = np.array([len(self.label), len(self.ends), len(self.letters)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.ends, self.n, self.first, self.word, self.label, self.letters))

    @classmethod
    def unpacked(cls, data: bytes) -> Trie:
        out, at = cls.__new__(cls), 24
        nodes, words, letters = np.frombuffer(data, np.int64, 3).tolist()
        for name, kind, many in (("ends", np.int64, words), ("n", np.int64, words), ("first", np.int32, nodes + 1), ("word", np.int32, nodes), ("label", np.uint8, nodes), ("letters", np.uint8, letters)):
            x = np.frombuffer(data, kind, many, at)
            setattr(out, name, x)
            at += x.nbytes
        # an edge by its upper node and label; edges are in this order
        out.keys = (np.repeat(np.arange(nodes, dtype=np.int64), np.diff(out.first)) << 8) | out.label[1:]
        return out

    def spelled(self, i: int) -> bytes:
        return self.letters[self.ends[i - 1] if i else 0 : self.ends[i]].tobytes()

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child of each node by a letter, or -1."""
        key = (node << 8) | letter
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at + 1, -1)


def neighbours(trie: Trie, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (place of a word in the pack, word number in the trie) at edit distance just one.

    A state is a word's place, its position, a node, and whether the edit is used. ``letters`` ends with a zero, which no
    trie has, so a position past a word's end may be read.
    """
    many = len(starts)
    stack = [(np.arange(many), np.zeros(many, np.int64), np.zeros(many, np.int64), np.zeros(many, bool))]
    while stack:
        w, i, v, used = stack.pop()
        if len(w) > BLOCK:
            stack.append((w[BLOCK:], i[BLOCK:], v[BLOCK:], used[BLOCK:]))
            w, i, v, used = w[:BLOCK], i[:BLOCK], v[:BLOCK], used[:BLOCK]
        done = i == sizes[w]
        end = done & used
        if end.any():
            hit = trie.word[v[end]]
            if (hit >= 0).any():
                yield w[end][hit >= 0], hit[hit >= 0].astype(np.int64)
            keep = ~end
            w, i, v, used, done = w[keep], i[keep], v[keep], used[keep], done[keep]
        c = np.where(done, 0, letters[starts[w] + i]).astype(np.int64)
        nxt = trie.step(v, c)
        on = nxt >= 0
        parts = [(w[on], i[on] + 1, nxt[on], used[on])]
        free = ~used
        if free.any():
            w, i, v, c, done = w[free], i[free], v[free], c[free], done[free]
            one = lambda x: np.ones(len(x), bool)
            # a letter of the word is left out: the first of equal ones
            out = ~done & ((i == 0) | (letters[starts[w] + i - 1] != c))
            parts.append((w[out], i[out] + 1, v[out], one(w[out])))
            # a letter of the trie replaces the word's, or comes before it
            kids = (trie.first[v + 1] - trie.first[v]).astype(np.int64)
            at = np.repeat(np.arange(len(v)), kids)
            kid = np.arange(len(at)) - np.repeat(np.cumsum(kids) - kids, kids) + np.repeat(trie.first[v], kids)
            other = trie.label[kid] != c[at]
            at, kid = at[other], kid[other].astype(np.int64)
            parts.append((w[at], i[at], kid, one(at)))
            swap = ~done[at]
            at, kid = at[swap], kid[swap]
            parts.append((w[at], i[at] + 1, kid, one(at)))
        merged = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        if len(merged[0]):
            stack.append(merged)


def shards(words: DataFrame, size: int = SHARD) -> DataFrame:
    """shard (a number), trie (packed), bytes: the vocabulary in order, cut into ranges; a task builds one shard at a time."""
    spark = words.sparkSession
    count = words.count()
    parts = max(1, min(-(-count // size), 8 * partitions(spark)))
    ordered = words.repartitionByRange(parts, "word").sortWithinPartitions("word")

    def run(batches):
        held, counts, letters = [], [], 0

        def shard():
            data = Trie(held, np.array(counts, np.int64)).packed()
            return pa.RecordBatch.from_pydict({"trie": pa.array([data], pa.binary()), "bytes": pa.array([len(data)], pa.int64())})

        for b in slices(batches, "word", LETTERS):
            for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                if len(held) >= size or letters >= LETTERS:
                    yield shard()
                    held, counts, letters = [], [], 0
                held.append(word.encode("latin-1"))
                counts.append(n)
                letters += len(word)
        if held:
            yield shard()

    return ordered.mapInArrow(run, "trie binary, bytes long").withColumn("shard", F.monotonically_increasing_id())


def packs(batches: Iterator[pa.RecordBatch], words: int = PACK, letters: int = LETTERS) -> Iterator[pa.RecordBatch]:
    """Cuts batches into packs by their words and by the letters of these (one longer word stays whole)."""
    for b in slices(batches, "word", letters):
        yield from (b.slice(i, words) for i in range(0, b.num_rows, words))


def gathered(blocks: Iterator[tuple[np.ndarray, np.ndarray]], most: int = HITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of ``neighbours`` in fewer blocks, closed at ``most`` pairs, so that dense vocabularies aren't held whole."""
    held, many = [], 0
    for block in blocks:
        held.append(block)
        many += len(block[0])
        if many >= most:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, many = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def matched(words: DataFrame, tries: list[bytes]) -> DataFrame:
    """word, n, n_near, form_n, form: the neighbours in some shards, reduced; one pass over the words, no shuffle."""
    sent = words.sparkSession.sparkContext.broadcast(tries)

    def run(batches):
        made = [Trie.unpacked(x) for x in sent.value]
        for b in packs(batches):
            pack = [w.encode("latin-1") for w in b.column("word").to_pylist()]
            sizes = np.fromiter(map(len, pack), np.int64, len(pack))
            letters, starts = np.frombuffer(b"".join(pack) + b"\0", np.uint8), np.cumsum(sizes) - sizes
            near, best, form = np.zeros(len(pack), np.int64), np.full(len(pack), -1, np.int64), [None] * len(pack)
            for trie in made:
                for w, hit in gathered(neighbours(trie, letters, starts, sizes)):
                    near += np.bincount(w, minlength=len(pack))
                    order = np.lexsort((hit, -trie.n[hit], w))  # word numbers are in code-point order
                    lead = order[np.concatenate([[True], w[order][1:] != w[order][:-1]])]
                    for p, k in zip(w[lead].tolist(), hit[lead].tolist(), strict=True):
                        # shards are not in order here, so equal counts compare the words
                        if (n := int(trie.n[k])) > best[p] or (n == best[p] and trie.spelled(k) < form[p]):
                            best[p], form[p] = n, trie.spelled(k)
            yield pa.RecordBatch.from_arrays(
                [b.column("word"), b.column("n"), pa.array(near), pa.array([None if x < 0 else x for x in best.tolist()], pa.int64()), pa.array([x and x.decode("latin-1") for x in form], pa.string())],
                ["word", "n", "n_near", "form_n", "form"],
            )

    return words.mapInArrow(run, "word string, n long, n_near long, form_n long, form string")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word of ``forms`` (word, form): the last of its chain, by pointer doubling.

    A round is written by as many tasks as its rows need, ``ROWS`` each: with a file for each of the shuffle's partitions the
    rounds would start most of the query's processes (on local disks Hadoop runs chmod for every file).
    """
    links = forms.select("word", F.col("form").alias("root"))
    tasks = max(1, -(-links.count() // ROWS))
    known = links
    while True:
        on = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = known.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        further = written(further.coalesce(tasks), "roots")
        moved = further.where("moved").limit(1).count()
        if known is not links:
            discard(known)
        known = further
        if not moved:
            return known.select("word", "root")


def variants(docs: DataFrame, size: int = SHARD, most: int = BROADCAST) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word; ``form`` has at least ``TIMES`` the word's count."""
    words = written(vocabulary(docs), "words")
    tries = written(shards(words, size), "tries")
    rounds: list[list[int]] = []
    held = most
    for r in tries.select("shard", "bytes").orderBy("shard").toLocalIterator():  # two numbers a shard
        if held + r["bytes"] > most:
            rounds.append([])
            held = 0
        rounds[-1].append(r["shard"])
        held += r["bytes"]
    dealt = words.repartition(min(2 * partitions(words.sparkSession), max(1, words.count() // PACK)))
    parts = []
    for numbers in rounds:
        sent = [bytes(r["trie"]) for r in tries.where(F.col("shard").between(numbers[0], numbers[-1])).select("trie").collect()]
        parts.append(written(matched(dealt, sent), "near"))
    if not parts:
        return words.select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    near = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            near = near.union(p)
        # the greatest count, of equal ones the least word
        lead = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("k"), F.col("form").alias("w"))))
        near = near.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), lead.alias("b"))
        near = written(near.select("word", "n", "n_near", (-F.col("b.k")).alias("form_n"), F.col("b.w").alias("form")), "nearest")
    formed = F.col("form_n") >= TIMES * F.col("n")
    ended = roots(near.where(formed).select("word", "form"))
    own = near.select("word", F.when(formed, F.col("form")).alias("form"), "n", "n_near", F.when(formed, F.col("form_n")).alias("form_n"))
    return own.join(ended, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
