"""Corpus scores of translations: BLEU, chrF and TER.

BLEU and chrF need clipped counts of n-grams. Pairs are dealt once by a number; then their n-grams are rows that the same task
groups by pair, order and n-gram, and sums up by pair. Nothing leaves the JVM, and only pairs are shuffled.

TER (Snover et al., 2006) is the least number of word edits where moving a span of words that matches the reference elsewhere
counts as one edit. Finding the fewest moves is intractable; as defined, the best single move is taken again and again, while
it pays. That search is an Arrow function over pairs: a pass weighs all candidate moves of a pair together, one column of the
edit table at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import partitions_by_size

WORD_ORDER, CHAR_ORDER, BETA = 4, 6, 2
PART = 128 << 10  # listed bytes of pairs in a partition, some hundred pairs
# Limits of the search for moves.
MOST_LENGTH, MOST_SHIFT, MOST_TRIES, BEAM = 10, 50, 1000, 25
# Entities that count as the characters they stand for.
ENTITIES = {"&quot;": '"', "&amp;": "&", "&lt;": "<", "&gt;": ">"}


def words_13a(text: Column) -> Column:
    """Words with punctuation apart, but not inside numbers; case is kept."""
    x = F.coalesce(text, F.lit(""))
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), *ENTITIES.items()):
        x = F.replace(x, F.lit(old), F.lit(new))
    x = F.concat(F.lit(" "), x, F.lit(" "))
    # signs other than , - . and digits, letters and blanks stand apart
    x = F.regexp_replace(x, r"([\x20-\x26\x28-\x2B\x2F\x3A-\x40\x5B-\x60\x7B-\x7E])", r" $1 ")
    for pattern, new in (("([^0-9])([.,])", "$1 $2 "), ("([.,])([^0-9])", " $1 $2"), ("([0-9])(-)", "$1 $2 ")):
        x = F.regexp_replace(x, pattern, new)
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def _common(sides: DataFrame, order: int) -> DataFrame:
    """i, n, m, p, r of rows (i, p, r: arrays): per pair and order the n-grams in common, each as often as on both sides, and of either.

    The n-grams are rows of a pair that a task holds already, so that they are counted where they are: no shuffle.
    """
    one = sides.select("i", F.explode(F.array(F.struct(F.lit(True).alias("pred"), F.col("p").alias("x")), F.struct(F.lit(False).alias("pred"), F.col("r").alias("x")))).alias("s")).select("i", "s.pred", "s.x")
    sized = one.select("i", "pred", "x", F.explode(F.array(*map(F.lit, range(1, order + 1)))).alias("n"))
    places = F.when(F.size("x") >= F.col("n"), F.sequence(F.lit(1), F.size("x") - F.col("n") + 1)).otherwise(F.array().cast("array<int>"))
    grams = sized.select("i", "pred", "n", "x", F.explode(places).alias("k")).select("i", "n", "pred", F.slice("x", F.col("k"), F.col("n")).alias("g"))
    counts = grams.groupBy("i", "n", "g").agg(F.count_if("pred").alias("a"), F.count_if(~F.col("pred")).alias("b"))
    return counts.groupBy("i", "n").agg(F.sum(F.least("a", "b")).alias("m"), F.sum("a").alias("p"), F.sum("b").alias("r"))


def statistics(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """One row a pair: clipped and all n-grams of words (m1.., t1..) and characters (cm1.., cp1.., cr1..), and lengths (cl, rl).

    As defined, characters of a prediction count for an order only where the reference has such n-grams.
    """
    solid = lambda c: F.filter(F.split(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", ""), ""), lambda x: x != "")
    # a task holds the n-grams of its pairs, thousands of a pair: so the number of partitions grows with the input
    parts = partitions_by_size(df, PART)
    pairs = df.select(F.col(pred).alias("p"), F.col(ref).alias("r")).withColumn("i", F.monotonically_increasing_id()).repartition(parts, "i")
    words = pairs.select("i", words_13a(F.col("p")).alias("p"), words_13a(F.col("r")).alias("r"))
    wide = lambda x, order, of: x.groupBy("i").agg(*[F.sum(F.when(F.col("n") == n, F.col(c)).otherwise(0)).alias(f"{name}{n}") for n in range(1, order + 1) for c, name in of])
    w = wide(_common(words, WORD_ORDER), WORD_ORDER, (("m", "m"), ("p", "t"), ("r", "u")))
    c = wide(_common(pairs.select("i", solid("p").alias("p"), solid("r").alias("r")), CHAR_ORDER), CHAR_ORDER, (("m", "cm"), ("p", "cp"), ("r", "cr")))
    x = pairs.select("i").join(w, "i", "left").join(c, "i", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    out = [zero("t1").alias("cl"), zero("u1").alias("rl")]
    out += [zero(f"{k}{n}").alias(f"{k}{n}") for n in range(1, WORD_ORDER + 1) for k in "mt"]
    for n in range(1, CHAR_ORDER + 1):
        out += [zero(f"cm{n}").alias(f"cm{n}"), F.when(zero(f"cr{n}") > 0, zero(f"cp{n}")).otherwise(0).alias(f"cp{n}"), zero(f"cr{n}").alias(f"cr{n}")]
    return x.select(*out)


def bleu(sums: dict[str, Column]) -> Column:
    """0 to 100 from summed statistics; an order without any match counts as half a match, the next such as a quarter, ..."""
    logs, halves = F.lit(0.0), F.lit(0)
    for n in range(1, WORD_ORDER + 1):
        m, t = sums[f"m{n}"], sums[f"t{n}"]
        halves = halves + (m == 0).cast("int")
        logs = logs + F.log(F.when(m > 0, m).otherwise(F.pow(F.lit(0.5), halves)) / F.greatest(t, F.lit(1.0)))
    brevity = F.when(sums["cl"] >= sums["rl"], 1.0).otherwise(F.exp(1 - sums["rl"] / F.greatest(sums["cl"], F.lit(1.0))))
    none = (sums["m1"] == 0) | (sums[f"t{WORD_ORDER}"] == 0)
    return F.when(none, 0.0).otherwise(100 * brevity * F.exp(logs / WORD_ORDER))


def chrf(sums: dict[str, Column]) -> Column:
    """0 to 100: F of mean precision and recall over the orders that both sides have."""
    p, r, orders = F.lit(0.0), F.lit(0.0), F.lit(0)
    for n in range(1, CHAR_ORDER + 1):
        m, a, b = (sums[f"{k}{n}"] for k in ("cm", "cp", "cr"))
        both = (a > 0) & (b > 0)
        p, r, orders = p + F.when(both, m / F.greatest(a, F.lit(1.0))).otherwise(0.0), r + F.when(both, m / F.greatest(b, F.lit(1.0))).otherwise(0.0), orders + both.cast("int")
    p, r = p / F.greatest(orders, F.lit(1)), r / F.greatest(orders, F.lit(1))
    return F.when(p + r == 0, 0.0).otherwise(100 * (1 + BETA**2) * p * r / (BETA**2 * p + r))


def _tables(many: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Edit distances of all prefixes: [place in the hypothesis, candidate, place in the reference].

    many: candidates of equal length, as rows of word numbers. Cells further from the diagonal than the beam are never reached.
    """
    n, m = many.shape[1], len(ref)
    ratio = m / n if n else 1.0
    beam = math.ceil(ratio / 2 + BEAM) if BEAM < ratio / 2 else BEAM
    cost = np.full((n + 1, len(many), m + 1), np.inf)
    cost[0] = np.arange(m + 1)
    steps = np.arange(m + 1)
    for i in range(1, n + 1):
        middle = math.floor(i * ratio)
        low, high = max(0, middle - beam), m + 1 if i == n else min(m + 1, middle + beam)
        before = cost[i - 1]
        row = before + 1  # a word too many
        np.minimum(row[:, 1:], before[:, :-1] + (many[:, i - 1, None] != ref[None]), out=row[:, 1:])
        row[:, :low] = np.inf
        row[:, high:] = np.inf
        # missing words: the least of all places before, plus the way from there
        row = np.minimum.accumulate(row - steps, axis=1) + steps
        row[:, :low] = np.inf
        row[:, high:] = np.inf
        cost[i] = row
    return cost


def _alignment(cost: np.ndarray, words: np.ndarray, ref: np.ndarray) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """Of the cheapest edits of one candidate: the hypothesis place of each reference place, and which places of both are wrong.

    Of equal edits pairs come before words too many, and these before missing ones. A missing word is aligned with the
    place before it.
    """
    i, j, pairs = len(words), len(ref), []
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (words[i - 1] != ref[j - 1]):
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            pairs.append((i, None))
        else:
            j -= 1
            pairs.append((None, j))
    at, align, wrong_h, wrong_r = -1, {}, np.zeros(len(words), bool), np.zeros(len(ref), bool)
    for a, b in reversed(pairs):
        if a is not None:
            at = a
        if b is not None:
            align[b] = at
            wrong_r[b] = a is None or words[a] != ref[b]
        if a is not None:
            wrong_h[a] = b is None or words[a] != ref[b]
    return align, wrong_h, wrong_r


def _moves(words: np.ndarray, ref: np.ndarray, align: dict[int, int], wrong_h: np.ndarray, wrong_r: np.ndarray, left: int) -> tuple[list[tuple[int, int, int]], int]:
    """(start, length, target) of the moves worth a try, and how many were listed, repeats included.

    A span of the hypothesis that equals one of the reference, wrong somewhere on either side, may go before or behind the
    places that the reference's span is aligned with. The list ends with the span that uses up what is ``left`` of the tries.
    """
    out, many = [], 0
    words, ref = words.tolist(), ref.tolist()
    # how many wrong places there are before each one; where each word stands in the reference
    sum_h, sum_r = ([0, *np.cumsum(x).tolist()] for x in (wrong_h, wrong_r))
    places: dict[int, list[int]] = {}
    for r, word in enumerate(ref):
        places.setdefault(word, []).append(r)
    for start, word in enumerate(words):
        for r in places.get(word, ()):
            if abs(r - start) > MOST_SHIFT:
                continue
            length = 0
            while length < MOST_LENGTH and start + length < len(words) and r + length < len(ref) and words[start + length] == ref[r + length]:
                length += 1
                if sum_h[start + length] == sum_h[start] or sum_r[r + length] == sum_r[r] or start <= align[r] < start + length:
                    continue
                last = None
                for k in range(-1, length):
                    target = 0 if r + k < 0 else align[r + k] + 1
                    if target != last:
                        last = target
                        out.append((start, length, target))
                        many += 1
                if many >= left:
                    return out, many
    return out, many


def _moved(words: np.ndarray, start: int, length: int, target: int) -> np.ndarray:
    """``words`` with a span put before the word at ``target`` (within the span: as far behind it)."""
    span, rest = words[start : start + length], np.concatenate([words[:start], words[start + length :]])
    at = target if target < start else target - length if target > start + length else target
    return np.concatenate([rest[:at], span, rest[at:]])


def edits(pred: str, ref: str) -> tuple[int, int]:
    """Edits with moves that turn ``pred`` into ``ref``, whatever the case, and the number of words of ``ref``."""
    number: dict[str, int] = {}
    words, ref = (np.array([number.setdefault(w, len(number)) for w in x.lower().split()], np.int64) for x in (pred, ref))
    if not len(ref) or not len(words):
        return max(len(words), len(ref)), len(ref)
    moves = tried = 0
    while True:
        cost = _tables(words[None], ref)
        now = int(cost[-1, 0, -1])
        align, wrong_h, wrong_r = _alignment(cost[:, 0], words, ref)
        tries, many = _moves(words, ref, align, wrong_h, wrong_r, MOST_TRIES - tried)
        tried += many
        if not tries or tried >= MOST_TRIES:
            return moves + now, len(ref)
        after, step = np.zeros(len(tries)), max(1, 2_000_000 // (len(ref) * len(words)))
        made = np.stack([_moved(words, *t) for t in tries])
        for i in range(0, len(tries), step):
            after[i : i + step] = _tables(made[i : i + step], ref)[-1, :, -1]
        # the cheapest; then the longest span, the earliest start and target
        best = min(range(len(tries)), key=lambda k: (after[k], -tries[k][1], tries[k][0], tries[k][2]))
        if after[best] >= now:
            return moves + now, len(ref)
        moves, words = moves + 1, made[best]


def ter_edits(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """ed, wl: edits and reference words of each pair; Arrow batches, no shuffle."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame([edits(p, r) for p, r in zip(f["p"], f["r"], strict=True)], columns=["ed", "wl"], dtype="int64")

    return df.select(F.coalesce(F.col(pred), F.lit("")).alias("p"), F.coalesce(F.col(ref), F.lit("")).alias("r")).mapInPandas(run, "ed long, wl long")


def corpus_scores(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """bleu, chrf and ter of a corpus; one row. Nulls are empty texts; an empty corpus scores 0."""
    s = statistics(df, pred, ref)
    names = s.columns
    sums = s.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("double").alias(n) for n in names])
    col = {n: F.col(n) for n in names}
    ter = ter_edits(df, pred, ref).agg(F.coalesce(F.sum("ed"), F.lit(0)).alias("ed"), F.coalesce(F.sum("wl"), F.lit(0)).alias("wl"))
    rate = F.when(F.col("wl") > 0, 100.0 * F.col("ed") / F.greatest(F.col("wl"), F.lit(1))).when(F.col("ed") > 0, 100.0).otherwise(0.0)
    return sums.select(bleu(col).alias("bleu"), chrf(col).alias("chrf")).join(ter.select(rate.alias("ter")))
