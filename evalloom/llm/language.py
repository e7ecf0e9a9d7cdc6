"""Language identification by prediction by partial matching.

One variable-order byte context tree per language (contexts of up to ``ORDER`` bytes, method-C escapes without
exclusion) gives every byte an exact code length under frozen statistics; the language of the shortest total code wins.
A tree is sparse: the code length of every string of a context and a byte that the sample has, and the escape length of
every context, as sorted arrays. Nothing that was counted is left out. A string that a tree lacks costs the escapes of
the contexts that it knows, down to the shorter string that it has. A piece's different strings are looked up once each.

Defined results: a null text or one without a letter is ``und`` with score 0; ties go to the first language in
alphabetical order; whole texts are scored, in pieces, so memory doesn't grow with them; an empty table gives an empty
result; without labelled rows every text is ``und``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_is_held_out, sampled, texts, written

ORDER = 3
MAX_PER_LANG = 1500  # the bound of the labelled sample, per language
PIECE = 1 << 20  # bytes that are scored together
_LETTER = re.compile(r"[^\W\d_]")
# every ASCII byte that is no letter becomes a blank; other bytes stay
_PLAIN = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """Whether a character is a letter; the pattern also finds signs like ``²`` and ``½``, which are none."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def plain(text: str) -> bytes:
    """Lower-case UTF-8 with ASCII non-letters as blanks, runs of blanks as one."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split()) + b" "


def strings(a: np.ndarray) -> np.ndarray:
    """The number of every four-byte string of ``a`` (uint8): three bytes of context and the byte that follows."""
    a = a.astype(np.uint32)
    return (a[:-3] << 24) | (a[1:-2] << 16) | (a[2:-1] << 8) | a[3:]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of four-byte strings by language; shorter contexts' counts are their sums."""
    held: dict[str, dict] = {}
    for b in batches:
        by: dict[str, list] = {}
        for text, lang in zip(texts(b.column("text")), b.column("lang").to_pylist(), strict=True):
            by.setdefault(lang, []).append(b"   " + plain(text))
        for lang, parts in by.items():
            keys, n = np.unique(strings(np.frombuffer(b"".join(parts), np.uint8)), return_counts=True)
            d = held.setdefault(lang, {})
            for k, c in zip(keys.tolist(), n.tolist(), strict=True):
                d[k] = d.get(k, 0) + c
    for lang, d in held.items():
        keys, n = list(d), list(d.values())
        for i in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(keys[i : i + 50_000]), "gram": pa.array(keys[i : i + 50_000], pa.int64()), "n": pa.array(n[i : i + 50_000], pa.int64())})


def _places(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in a sorted array that isn't empty, and whether they are there."""
    at = np.searchsorted(sorted_, wanted).clip(max=len(sorted_) - 1)
    return at, sorted_[at] == wanted


class Tree:
    """The frozen context tree of one language, from its four-byte strings and their counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        grams, counts = grams[order].astype(np.int64), counts[order].astype(np.float64)
        # by order: strings, their bits, contexts, the bits of their escapes
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        p = below = np.zeros(0)
        for k in range(ORDER + 1):
            keys, back = np.unique(grams & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(back, counts)
            contexts, of = np.unique(keys >> 8 if k else np.zeros_like(keys), return_inverse=True)
            seen, kinds = np.bincount(of, n), np.bincount(of)
            # the order below has every string of this one without its first byte
            p = p[np.searchsorted(below, keys & ((1 << 8 * k) - 1))] if k else np.full(len(keys), 1 / 256)
            p, below = (n + kinds[of] * p) / (seen + kinds)[of], keys
            self.levels.append((keys.astype(np.uint32), -np.log2(p), contexts.astype(np.uint32), -np.log2(kinds / (seen + kinds))))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """The code length of each string's last byte after the others."""
        out, left = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(ORDER, -1, -1):
            keys, bits, contexts, escapes = self.levels[k]
            mine = grams[left] & np.uint32((1 << 8 * (k + 1)) - 1)
            at, there = _places(keys, mine)
            out[left[there]] += bits[at[there]]
            left, mine = left[~there], mine[~there]
            at, there = _places(contexts, mine >> np.uint32(8) if k else np.zeros_like(mine))
            out[left[there]] += escapes[at[there]]  # a context that isn't known passes on wholly
        out[left] += 8
        return out


class Trees:
    """The trees of all languages; ``grams`` has their strings and counts."""

    def __init__(self, langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.trees = langs, [Tree(*grams[x]) for x in langs]

    def lengths(self, parts: list[bytes]) -> np.ndarray:
        """Code length in bits of each part under each language; a part's first three bytes are context only."""
        a = strings(np.frombuffer(b"".join(parts), np.uint8))
        sizes = np.array([len(x) - 3 for x in parts])
        ends, starts = np.cumsum(sizes), np.cumsum(sizes + 3) - sizes - 3
        kinds, back = np.unique(a[np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)], return_inverse=True)
        return np.stack([np.add.reduceat(t.bits(kinds)[back], ends - sizes) for t in self.trees], 1)

    def predict(self, every: list[str]) -> list[tuple[str, float, float]]:
        """Language, its share of the posterior, and its bits a byte, of each text."""
        out = [("und", 0.0, 0.0)] * len(every)
        total, sizes, parts, of, held = {}, {}, [], [], 0

        def score() -> None:
            if parts:
                for i, bits in zip(of, self.lengths(parts), strict=True):
                    total[i] = total.get(i, 0) + bits

        for i, t in enumerate(every):
            if not self.langs or not has_letter(t):
                continue
            data = plain(t)
            sizes[i] = len(data)
            data = b"   " + data
            for j in range(3, len(data), PIECE):
                parts.append(data[j - 3 : j + PIECE])
                of.append(i)
                held += len(parts[-1])
                if held >= PIECE:
                    score()
                    parts, of, held = [], [], 0
        score()
        for i, bits in total.items():
            k = int(bits.argmin())
            out[i] = self.langs[k], float(1 / np.exp2(np.maximum(bits[k] - bits, -1000)).sum()), float(bits[k] / sizes[i])
        return out


class _Shared:
    """Builds the trees once a Python worker from the broadcast counts."""

    def __init__(self, counts):
        self.counts, self.token = counts, uuid.uuid4().hex

    def get(self) -> Trees:
        if self.token not in _MADE:
            _MADE.clear()
            _MADE[self.token] = Trees(*self.counts.value)
        return _MADE[self.token]


_MADE: dict = {}


def fit(docs: DataFrame, bound: int = MAX_PER_LANG):
    """All counts of a bounded labelled sample outside the held-out fold, as (languages, strings and counts by language).

    The counts come to the driver packed, one row a language, 12 bytes for each different string of four bytes; at most
    about ``bound`` rows a language stand behind them.
    """
    rows = docs.where(F.col("lang").isNotNull() & ~fold_is_held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sample = written(sampled(rows, F.col("lang"), F.col("doc_id"), bound).select("lang", "text"), "lang-sample")

    def pack(t: pa.Table) -> pa.Table:
        g, n = (t.column(c).to_numpy() for c in ("gram", "n"))
        return pa.table({"lang": t.column("lang").slice(0, 1), "grams": pa.array([g.astype(np.uint32).tobytes()], pa.binary()), "counts": pa.array([n.astype(np.int64).tobytes()], pa.binary())})

    counts = sample.mapInArrow(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    models = counts.groupBy("lang").applyInArrow(pack, "lang string, grams binary, counts binary").collect()
    return sorted(r["lang"] for r in models), {r["lang"]: (np.frombuffer(r["grams"], np.uint32), np.frombuffer(r["counts"], np.int64)) for r in models}


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte for every row; one pass, no shuffle."""
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(model))

    def run(batches):
        trees = shared.get()
        for b in batches:
            found = trees.predict(list(texts(b.column("text"))))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "lang_pred": pa.array([x[0] for x in found], pa.string()), "score": pa.array([x[1] for x in found], pa.float64()), "bits_per_byte": pa.array([x[2] for x in found], pa.float64())})

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")
    return out.select("doc_id", fold_is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def language(docs: DataFrame) -> DataFrame:
    """Query form: learn, then predict every document."""
    return predict(docs, fit(docs))
