"""Relational analytics: comparisons of runs, top-k, upserts, roll-ups, sampling, windows over tokens."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import let


def evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` that are evaluated just once a row, where they stand.

    A costly expression is otherwise repeated in each filter and column that uses it, also before a shuffle that should spread
    it; none of that goes past an explode, here of one entry.
    """
    one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.explode(one).alias("__evaluated")).select(*df.columns, *[F.col(f"__evaluated.{n}").alias(n) for n in columns])


def compare_models(a: DataFrame, b: DataFrame, key: str, score: str) -> DataFrame:
    """Rows of both runs with score_1, score_2 and delta."""
    x, y = a.select(key, F.col(score).alias("score_1")), b.select(key, F.col(score).alias("score_2"))
    return x.join(y, key).withColumn("delta", F.col("score_1") - F.col("score_2"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; rows beyond them leave before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def keep_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key, by a partial aggregate: no key's rows meet in one task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old``."""
    return keep_last(old.withColumn("__s", F.lit(0)).unionByName(new.withColumn("__s", F.lit(1))), keys, "__s").drop("__s")


def run_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Values of two runs by task, delta and percentage; a task of one run only stays."""
    x, y = a.select(key, F.col(value).alias("before")), b.select(key, F.col(value).alias("after"))
    d = F.col("after") - F.col("before")
    return x.join(y, key, "full").select(key, "before", "after", d.alias("delta"), F.try_divide(100 * d, F.col("before")).alias("percent"))


def subtask(text: Column) -> Column:
    """Canonical subtask of a free text: the first known name it contains, whatever the case."""
    names = ["Concrete Recognition", "Analytical Questions", "Divergent Thinking", "Real-world Assistance", "Further Insights"]
    out = F.when(text.isNull() | (F.trim(text) == ""), F.lit("Not Specified"))
    for n in names:
        out = out.when(F.lower(text).contains(n.lower()), n)
    return out.otherwise("Further Insights")


def subtask_rollup(df: DataFrame, key: str, score: str) -> DataFrame:
    """Count and mean of ten-point scores as percent, by subtask and in total (``Total``); -1 means unscored."""
    x = df.where(F.col(score) != -1)
    return x.rollup(key).agg(F.count(F.lit(1)).alias("n"), (F.avg(score) * 10).alias("score")).select(F.coalesce(key, F.lit("Total")).alias(key), "n", "score")


def shard(df: DataFrame, seq: str, rank: int, world: int, limit: int | None = None) -> DataFrame:
    """Every ``world``-th row from ``rank`` on, below ``limit``."""
    c = F.col(seq)
    out = df.where((c >= rank) & (F.pmod(c - rank, F.lit(world)) == 0))
    return out.where(c < limit) if limit is not None else out


def sample_size(n: int, limit: float | None) -> int | None:
    """A limit below 1 is a share of the rows, rounded up."""
    return None if limit is None else math.ceil(n * limit) if limit < 1 else int(limit)


def fewshot_ids(n: int, k: int, seed: int = 1234) -> list[int]:
    return random.Random(seed).sample(range(n), k)


def rolling_windows(tokens: Column, size: int, context: int = 1) -> Column:
    """array<struct<context, target>>: windows that predict every token once, each with up to ``size`` input tokens.

    The first window predicts ``size`` tokens from the start token's place on, later ones ``size - context + 1`` each.
    """
    step = size - context + 1

    def windows(x):  # the tokens and their number are evaluated once, not for each window
        n = x["n"]
        starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.concat(F.array(F.lit(0)), F.sequence(F.lit(size), n - 1, F.lit(step))))

        def one(s):
            end = F.least(n, s + F.when(s == 0, size).otherwise(step))
            begin = F.when(s == 0, 0).otherwise(F.greatest(F.lit(0), end - size - 1))
            return F.struct(F.slice(x["t"], begin + 1, s - begin).alias("context"), F.slice(x["t"], s + 1, end - s).alias("target"))

        return F.when(n > 0, F.transform(starts, one))

    return let(let(tokens, lambda t: F.struct(t.alias("t"), F.size(t).alias("n"))), windows)


def segment_frames(first: Column, last: Column, count: int) -> Column:
    """Frame numbers at the middles of ``count`` equal segments, halves to even."""
    size = (last - first) / F.lit(float(count))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.rint(first + size / 2 + size * i).cast("int"))


def chunks(values: Column, size: int) -> Column:
    """Consecutive slices of ``size``; the last may be shorter."""
    n = F.size(values)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), lambda i: F.slice(values, i + 1, F.lit(size))))


def kcenter(df: DataFrame, key: str, vector: str, k: int, candidates: int = 4096) -> DataFrame:
    """key, pick: ``k`` rows chosen greedily, each the farthest from those chosen before (smallest key of ties and first).

    A round ships the centres so far, and each task sends the ``candidates`` rows that are farthest from all of them; the
    farthest overall come to the driver. Distances only fall as centres are added, so the driver can go on choosing among
    these as long as its farthest is farther than any row that stayed behind was. A round gives at least one pick, most
    give many; rows stay where they are, and neither plan nor memory grows with the table. Rows with a null key or vector
    take no part.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("k is not null and v is not null")
    spark = df.sparkSession
    picks: list[int] = []
    centres: list[np.ndarray] = []

    def farthest(centres: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
                d = np.full(len(x), np.inf)
                for c in centres:
                    np.minimum(d, ((x - c) ** 2).sum(1), out=d)
                new = (b.column("k").to_numpy(), d, x)
                held = new if held is None else tuple(np.concatenate(p) for p in zip(held, new, strict=True))
                best = np.lexsort((held[0], -held[1]))[: candidates + 1]
                held = tuple(p[best] for p in held)
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), pa.array(list(held[2]), pa.list_(pa.float64()))], ["k", "d", "v"])

        return run

    while len(picks) < k:
        found = rows.mapInArrow(farthest(np.array(centres)), "k long, d double, v array<double>").orderBy(F.desc("d"), "k").limit(candidates + 1).toArrow()
        if not found.num_rows:
            break
        ids, d = found.column("k").to_numpy(), found.column("d").to_numpy().copy()
        x = np.stack([np.array(v) for v in found.column("v").to_pylist()])
        beyond = d[-1] if len(d) > candidates else -1.0  # no row that stayed behind is farther
        first = True
        while len(picks) < min(k, len(ids) if beyond < 0 else k):
            best = int(np.lexsort((ids, -d))[0])
            if not first and d[best] <= beyond:
                break
            if d[best] == 0 and beyond < 0 and len(set(picks)) >= len(ids):
                break
            picks.append(int(ids[best]))
            centres.append(x[best])
            np.minimum(d, ((x - x[best]) ** 2).sum(1), out=d)
            first = False
        if beyond < 0:
            break
    return spark.createDataFrame([(p, i) for i, p in enumerate(picks)], "key long, pick int")
