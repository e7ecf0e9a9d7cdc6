"""Toxicity: a weighted lexicon, matched by Aho-Corasick after folding homoglyphs and digit substitutions.

Weights are log rate ratios learned from a bounded sample of labelled rows, in which copies of a text, exact or near,
share the weight of one row. Entries are taken one at a time, each for the toxic rows that none before it explains, so
that words which only go along with a toxic one stay out. A document's evidence is the weighted number of its hits, less what as many words would show by chance (the normalisation by length); longer texts than ``WINDOW`` words are judged by the
window with the most evidence, each by the rule for a text of its length. A logistic curve, fitted on the same sample, turns evidence into a score. Hits inside an exception phrase don't count.

Every hit counts, however many there are. Defined results: a null or empty text has no hits and gets the curve's value
there; words of any length match whole and by their start; repeated rows get equal scores; an empty table gives an empty result. Without labelled rows of both
classes the seed lexicon is used with its default weight.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_is_held_out, rows, sampled, texts, written

# Common insults, used with a default weight where training has not seen them.
SEEDS = "idiot stupid moron loser scum trash worthless pathetic disgusting clown dumb imbecile cretin".split()
SEED = 3.0  # weight of a seed word that training has not seen, and the most of any other
# Phrases in which such a word is harmless.
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "take out the trash", "clown fish", "sore loser rule", "class clown award", "pond scum"]
# Letters that look like Latin ones, as pairs of look-alikes and Latin letters.
LOOKALIKES = ("авсԁеһіјӏкмоԛѕтурѵхᴀᴇɪᴏᴜαβεικνορτυχ", "abcdehijlkmoqstypvxaeiouabeiknoptux")
# Digits and signs written for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
MAX_PER_CLASS = 4000  # the bound of the labelled sample, per class
LIMIT = 0.7
WINDOW, STEP = 2000, 500  # words of the windows in which longer texts are judged, and from one window to the next


class _Fold(dict):
    """A translation table that decides each character once: a letter, its folded form, or a blank."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if 0xFF21 <= code <= 0xFF5A:
            c = chr(code - 0xFEE0).lower()
        c = self.alike.get(c, DIGITS.get(c, c))
        # "1" may stand for i or l, so both fold to one letter
        out = "i" if c in "il|" else c if c.isalpha() else "" if code in (0xAD, 0x200B, 0x200C, 0x200D) else " "
        self[code] = out
        return out

    alike = dict(zip(*LOOKALIKES, strict=True))


_TABLE = _Fold()


def fold(text: str) -> str:
    """Lower case, look-alikes and digits as letters, everything else blank; framed by blanks.

    ``$`` and ``@`` count as letters only between letters, so that trailing signs don't hide a word's end.
    """
    text = text.lower()
    for sign in "$@":
        if sign in text:
            parts = text.split(sign)
            joined = [parts[0]]
            for a, b in zip(parts, parts[1:], strict=False):
                joined += [sign if a[-1:].isalpha() and b[:1].isalpha() else " ", b]
            text = "".join(joined)
    return f" {text.translate(_TABLE)} "


def _features(words: list[str]) -> Counter:
    """How often each whole word and each word start of 3 to 8 letters occurs."""
    out: Counter = Counter()
    for w, n in Counter(words).items():
        out[f" {w} "] += n
        for k in range(3, min(8, len(w)) + 1):
            out[f" {w[:k]}"] += n
    return out


def _copy_key(words: list[str]) -> int:
    """The least hash of the five-word runs: equal for copies and most near copies, hardly ever for unrelated texts."""
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0) >> 1


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_pydict({"text": b.column("text"), "toxic": b.column("toxic"), "copies": pa.array([_copy_key(fold(t).split()) for t in texts(b.column("text"))], pa.int64())})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict = {0: Counter(), 1: Counter()}
    docs: dict = {0: Counter(), 1: Counter()}
    for b in batches:
        for text, label, share in zip(texts(b.column("text")), b.column("toxic").to_pylist(), b.column("share").to_pylist(), strict=True):
            mine, in_docs = counts[label], docs[label]
            for f, n in _features(fold(text).split()).items():
                mine[f] += n * share
                in_docs[f] += share
                if f.endswith(" "):
                    mine[""] += n * share
            in_docs[""] += share
    for label in (0, 1):
        names = [f for f in docs[label]]
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"feature": part, "label": pa.array([label] * len(part), pa.int32()), "n": [float(counts[label][x]) for x in part], "docs": [docs[label][x] for x in part]})


def _candidates(stats: dict[str, tuple[float, float, float, float]]) -> dict[str, tuple[float, float, float]]:
    """Features that toxic rows have too often: rows expected by chance, and both rates, most significant first.

    stats: n and rows in clean, then in toxic rows.
    """
    n0, d0, n1, d1 = stats.get("", (0.0, 0.0, 0.0, 0.0))
    found = []
    for f, (c0, k0, c1, k1) in stats.items() if d0 and d1 else ():
        a, b, usual = (c1 + 0.5) / (n1 + 1), (c0 + 0.5) / (n0 + 1), (k0 + 0.5) / (d0 + 1) * d1
        if f and a / b >= 3 and _significant(k1, usual, d1):
            found.append((-float(_surprise(k1, usual)), f, (usual, a, b)))
    return {f: x for _, f, x in sorted(found)}


def _significant(rows, usual, toxic):
    """Rows decide, not words: words repeated within one row prove little. Works on numbers and arrays."""
    return (rows >= max(5.0, 0.004 * toxic)) & (rows >= 2 * usual) & (rows - usual >= 4 * np.sqrt(usual + 1))


def _surprise(rows, usual):
    """How much better its own rate explains a feature's number than chance does (Poisson log likelihood)."""
    return rows * np.log(np.maximum(rows, 1e-9) / usual) - (rows - usual)


def seed_features() -> list[str]:
    return [f" {fold(w).strip()} " for w in SEEDS]


def _lexicon(candidates: dict[str, tuple[float, float, float]], rows: list[tuple[list[int], list[int], float]], words: float, seeds: dict[str, float] | None = None) -> tuple[dict[str, float], float]:
    """Entries with weights, and the expected evidence of one word.

    rows: of each toxic row its candidates, how often it has them, and its share; words: the number in toxic rows; seeds:
    log ratios of the rates in toxic and clean rows of the seed words that training has seen. These count by their ratio, if
    it is that of a candidate; a seed never seen has ``SEED`` as weight.
    """
    names = list(candidates)
    usual, clean_words = np.array([candidates[f][0] for f in names]), np.array([candidates[f][2] * (words + 1) for f in names])
    # of entries alike, whole words and longer starts win near-ties
    liking = np.array([1.1 if f.endswith(" ") else 1 + 0.005 * len(f) for f in names])
    share = np.array([w for _, _, w in rows])
    # (row, candidate, times) of all that occur, as three arrays
    row = np.repeat(np.arange(len(rows)), [len(ids) for ids, _, _ in rows])
    of, times = (np.concatenate([np.asarray(r[k], np.int64) for r in rows]) if rows else np.zeros(0, np.int64) for k in (0, 1))
    toxic, chosen = share.sum(), {}
    while names:
        mine = share[row]
        left = np.bincount(of, mine, len(names))
        gain = np.where(_significant(left, usual, toxic), _surprise(np.bincount(of, mine * times, len(names)), clean_words) * liking, 0)
        k = int(gain.argmax())
        if gain[k] <= 0:
            break
        _, a, b = candidates[names[k]]
        chosen[names[k]] = math.log(a / b)
        share[row[of == k]] = 0
    chance = sum((candidates[f][1] - candidates[f][2] for f in chosen), 0.0)
    for f in seed_features():
        weight = min(SEED, (seeds or {}).get(f, SEED))
        if weight >= math.log(3) and not any(f.startswith(g) for g in chosen):
            chosen.setdefault(f, weight)
    return chosen, chance


def _evidence(automaton: ahocorasick.Automaton, chance: float, text: str) -> tuple[float, int]:
    """Length-normalised weight of the hits, of the window with the most in texts of more than one, and the number of all hits."""
    folded = fold(text)
    shut, found = -1, []
    for end, (feature, weight) in automaton.iter(folded):
        start = end - len(feature) + 1
        if weight is None:
            while found and found[-1][0] >= start:
                found.pop()
            shut = max(shut, end)
        elif start >= shut:
            found.append((start, feature, weight))
    words = folded.count(" ")

    def total(hits, words: int) -> float:
        return sum(w for _, _, w in hits) - chance * words

    if words <= WINDOW:
        return total(found, words), len(found)
    blanks = [i for i, c in enumerate(folded) if c == " "]
    places = sorted((bisect_right(blanks, start) - 1, f, w) for start, f, w in found)
    at = [x[0] for x in places]
    windows = [*range(0, words - WINDOW, STEP), words - WINDOW]
    return max(total(places[bisect_left(at, i) : bisect_left(at, i + WINDOW)], WINDOW) for i in windows), len(found)


class Toxicity:
    """A fitted model; small, and shipped to the executors with the function that uses it."""

    def __init__(self, weights: dict[str, float], chance: float, slope: float = 1.0, middle: float = 2.0):
        self.weights, self.chance, self.slope, self.middle = weights, chance, slope, middle
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def evidence(self, text: str) -> tuple[float, int]:
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for f, w in self.weights.items():
                self._automaton.add_word(f, (f, w))
            for p in EXCEPTIONS:
                p = f" {' '.join(fold(p).split())} "
                self._automaton.add_word(p, (p, None))
            self._automaton.make_automaton()
        return _evidence(self._automaton, self.chance, text)

    def score(self, text: str) -> tuple[float, int]:
        e, hits = self.evidence(text)
        z = max(-500.0, min(500.0, self.slope * (e - self.middle)))
        return 1 / (1 + math.exp(-z)), hits


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_PER_CLASS) -> Toxicity:
    """Learns from documents outside the held-out fold, on labels of at most about ``bound`` ids per class.

    The bounded list of ids is broadcast, so no text moves before the sample is cut; the sample is written once. Of
    several labels of one id the largest counts. Only word counts and evidence of the sample come to the driver.
    """
    marks = labels.where(~fold_is_held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = F.broadcast(sampled(marks, F.col("toxic"), F.col("doc_id"), bound))
    keyed = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic").mapInArrow(_keyed, "text string, toxic int, copies long")
    sample = written(keyed, "toxic-sample")
    sizes = sample.groupBy("toxic", "copies").agg((1 / F.count(F.lit(1))).alias("share"))
    shared = sample.join(F.broadcast(sizes), ["toxic", "copies"])
    counted = shared.mapInArrow(_count, "feature string, label int, n double, docs double").groupBy("feature").agg(
        *[F.sum(F.when(F.col("label") == k, F.col(c)).otherwise(0.0)).alias(f"{c}{k}") for k in (0, 1) for c in ("n", "docs")]
    ).where((F.col("docs1") >= 4.9) | F.col("feature").isin("", *seed_features()))  # others can't be significant
    stats = {r[0]: tuple(r[1:]) for r in counted.collect()}
    candidates = _candidates(stats)
    number = {f: i for i, f in enumerate(candidates)}

    def held(batches):
        for b in batches:
            found = [[(number[f], n) for f, n in _features(fold(t).split()).items() if f in number] for t in texts(b.column("text"))]
            yield pa.RecordBatch.from_pydict({"ids": pa.array([[i for i, _ in x] for x in found], pa.list_(pa.int32())), "times": pa.array([[n for _, n in x] for x in found], pa.list_(pa.int32())), "share": b.column("share")})

    toxic = shared.where("toxic = 1").mapInArrow(held, "ids array<int>, times array<int>, share double").collect() if number else []
    n0, _, n1, _ = stats.get("", (0.0, 0.0, 0.0, 0.0))
    seeds = {f: math.log((stats[f][2] + 0.5) / (n1 + 1) / ((stats[f][0] + 0.5) / (n0 + 1))) for f in seed_features() if f in stats}
    weights, chance = _lexicon(candidates, [(r.ids, r.times, r.share) for r in toxic], n1, seeds)
    model = Toxicity(weights, chance)

    def judge(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"toxic": b.column("toxic"), "e": pa.array([model.evidence(t)[0] for t in texts(b.column("text"))], pa.float64())})

    seen = sample.mapInArrow(judge, "toxic int, e double").toPandas()
    if len(set(seen["toxic"])) == 2:
        model.slope, model.middle = _curve(seen["e"].to_numpy(), seen["toxic"].to_numpy())
    return model


def _curve(e: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of one variable by Newton's method, classes weighted alike."""
    unit = max(1e-6, float(np.median(abs(e - np.median(e[y == 0]))[y == 1])) / 4)
    x = np.stack([e / unit, np.ones(len(e))], 1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    b = np.array([1.0, -2.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (weight * (y - p)) - 1e-2 * b)
        b = b + np.clip(step, -1, 1)
        if abs(step).max() < 1e-9:
            break
    slope = max(float(b[0]), 0.05)
    return slope / unit, float(-b[1] / slope * unit)


def score(docs: DataFrame, model: Toxicity, columns: list[str], limit: float = LIMIT) -> DataFrame:
    """``columns`` of ``docs`` (without clashing names) with score, predicted and n_hits; one pass, no shuffle."""
    kept = [c for c in columns if c.lower() not in ("score", "predicted", "n_hits")]
    source = rows(docs, [*kept, "text"])  # the text stands last, whether it is kept or not
    schema = T.StructType(source.schema["row"].dataType.fields[:-1]).add("score", "double").add("predicted", "integer").add("n_hits", "long")

    def run(batches):
        for b in batches:
            r = b.column("row")
            found = [model.score(t) for t in texts(r.field(len(kept)))]
            scores = [pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= limit) for s, _ in found], pa.int32()), pa.array([h for _, h in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([r.field(i) for i in range(len(kept))] + scores, [*kept, "score", "predicted", "n_hits"])

    return source.mapInArrow(run, schema)


def clean(docs: DataFrame, model: Toxicity, limit: float = LIMIT) -> DataFrame:
    """``docs`` without the rows whose score reaches ``limit``; all columns stay as they are."""
    columns = docs.columns
    source, at = rows(docs, columns), columns.index("text")

    def run(batches):
        for b in batches:
            r = b.column("row")
            keep = pa.array([model.score(t)[0] < limit for t in texts(r.field(at))], pa.bool_())
            yield pa.RecordBatch.from_arrays([r.field(i).filter(keep) for i in range(len(columns))], columns)

    return source.mapInArrow(run, source.schema["row"].dataType)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Query form: doc_id, held_out, score, predicted, n_hits for every document."""
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", fold_is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_hits")
