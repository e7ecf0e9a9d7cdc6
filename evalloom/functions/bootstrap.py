"""Standard errors by resampling, where no node need hold all values.

Chunk c of the resamples draws from all values, in order, by Python's generator seeded with c. The values are written as
blocks of one range of places each. For a statistic of sums (a ``Fold``) a task holds one block: it makes the chunk's draws
again, adds up those that fall into its block, and an aggregate adds the blocks' sums. So a table of any size can be resampled;
making the draws is the work, once for each block. Any other function of a resample needs all its values at once, as a list:
its tasks gather the blocks in order, 8 bytes a number, and the driver holds none.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

BLOCK = 1 << 20  # values of a block
DRAWS = 1 << 20  # draws made at a time


@dataclass(frozen=True)
class Fold:
    """A statistic of sums over a resample.

    parts: from values (one row each) to terms (one row each) that are summed; finish: from the sums and the resample's size.
    """

    parts: Callable[[np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray, int], float]


@dataclass(frozen=True)
class Middle:
    """The value drawn in the middle place; it is the median of the toolkit, which doesn't sort."""


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def _binary(v: np.ndarray) -> np.ndarray:
    """Right positives, gold and predicted positives, right negatives, of rows (gold, predicted)."""
    g, p = v[:, 0] == 1, v[:, 1] == 1
    return np.stack([g & p, g, p, ~g & ~p], 1).astype(float)


def _mcc(s: np.ndarray, n: int) -> float:
    tp, gold, pred, tn = s
    fn, fp = gold - tp, pred - tp
    return _ratio(tp * tn - fp * fn, math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


MEAN = Fold(lambda v: v, lambda s, n: s[0] / n)
PERPLEXITY = Fold(lambda v: v, lambda s, n: math.exp(-s[0] / n))
F1 = Fold(_binary, lambda s, n: _ratio(2 * s[0], s[1] + s[2]))
MCC = Fold(_binary, _mcc)


def _bleu(s: np.ndarray, n: int) -> float:
    """From rows cl, rl, m1, t1, ..., m4, t4."""
    m, t, halves, logs = s[2::2], s[3::2], 0, 0.0
    if not m[0] or not t[-1]:
        return 0.0
    for a, b in zip(m, t, strict=True):
        halves += not a
        logs += math.log((a or 0.5**halves) / b)
    return 100 * (1 if s[0] >= s[1] else math.exp(1 - s[1] / s[0])) * math.exp(logs / len(m))


def _chrf(s: np.ndarray, n: int) -> float:
    """From rows cm1, cp1, cr1, ..."""
    m, p, r = s[0::3], s[1::3], s[2::3]
    both = (p > 0) & (r > 0)
    if not both.any():
        return 0.0
    a, b = (m[both] / p[both]).mean(), (m[both] / r[both]).mean()
    return 100 * _ratio(5 * a * b, 4 * a + b)


BLEU, CHRF = Fold(lambda v: v, _bleu), Fold(lambda v: v, _chrf)
TER = Fold(lambda v: v, lambda s, n: 100 * s[0] / s[1] if s[1] else 100.0 * (s[0] > 0))  # from rows edits, words


def draws(chunk: int, n: int, resamples: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(resample, first draw, places of some draws): what Python's ``Random(chunk).choices`` takes of ``n`` values, over and over."""
    state = random.Random(chunk).getstate()[1]
    rnd = np.random.RandomState()
    rnd.set_state(("MT19937", np.array(state[:-1], np.uint32), state[-1]))
    for i in range(resamples):
        for at in range(0, n, DRAWS):
            yield i, at, (rnd.random_sample(min(DRAWS, n - at)) * float(n)).astype(np.int64)


def blocks(df: DataFrame, value: Column, seq: list[str], size: int) -> tuple[DataFrame, int]:
    """start, n, data (doubles, a row of them for an array) of the values in order of ``seq``, written; and their number."""
    x = df.select(*[F.col(c) for c in seq], value.cast("array<double>").alias("__v") if isinstance(df.select(value.alias("v")).schema["v"].dataType.jsonValue(), dict) else F.array(value.cast("double")).alias("__v"))
    x = x.where(F.col("__v").isNotNull() & ~F.exists("__v", lambda c: c.isNull()))
    ranged = x.repartitionByRange(*seq, "__v").sortWithinPartitions(*seq, "__v").withColumn("range", F.spark_partition_id()).select("range", "__v")

    def pack(batches):
        held, number, k, part = [], 0, 0, None

        def out():
            return pa.RecordBatch.from_pydict({"range": pa.array([part], pa.int32()), "k": pa.array([k], pa.int64()), "n": pa.array([number], pa.int64()), "data": pa.array([b"".join(held)], pa.binary())})

        for b in batches:
            width = None
            for i in range(0, b.num_rows, size):
                s = b.slice(i, min(size, b.num_rows - i))
                part = s.column("range")[0].as_py()
                flat = s.column("__v").flatten().to_numpy()
                width = len(flat) // s.num_rows
                at = 0
                while at < s.num_rows:
                    take = min(size - number, s.num_rows - at)
                    held.append(flat[at * width : (at + take) * width].tobytes())
                    number, at = number + take, at + take
                    if number == size:
                        yield out()
                        held, number, k = [], 0, k + 1
        if number:
            yield out()

    packed = written(ranged.mapInArrow(pack, "range int, k long, n long, data binary"), "values")
    ranges = packed.groupBy("range").agg(F.sum("n").alias("all")).withColumn("before", F.sum("all").over(Window.orderBy("range")) - F.col("all"))
    within = packed.select("range", "k", "n").withColumn("within", F.sum("n").over(Window.partitionBy("range").orderBy("k")) - F.col("n"))
    starts = within.join(F.broadcast(ranges), "range").select("range", "k", (F.col("before") + F.col("within")).alias("start"))
    total = packed.agg(F.sum("n")).first()[0] or 0
    return packed.join(starts, ["range", "k"]).select("start", "n", "data"), int(total)


def resampled(df: DataFrame, value: Column, seq: list[str], statistic: Fold | Middle | Callable[[list], float], iterations: int = 1000, size: int = BLOCK) -> DataFrame:
    """s: the statistic of each of ``iterations`` resamples, in chunks of 1000 at most."""
    spark = df.sparkSession
    packed, total = blocks(df, value, seq, size)
    chunk = min(1000, iterations)
    chunks = iterations // chunk if chunk else 0
    if not total or not chunks:
        return spark.createDataFrame([], "s double")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = -(-total // size)

    def whole(batches):
        """Chunks by any function: the blocks of a chunk come in order, the last one completes it."""
        held, number = [], 0
        for b in batches:
            for r in b.to_pylist():
                held.append(np.frombuffer(r["data"]))
                number += r["n"]
                if number == total:
                    flat = np.concatenate(held)
                    kinds, at = np.unique(flat, return_inverse=True)
                    kinds = kinds.tolist()
                    values = [kinds[k] for k in at] if len(flat) == total else list(map(tuple, flat.reshape(total, -1)))  # equal values share one object
                    held, number = [], 0
                    rnd = random.Random(r["chunk"])
                    yield pa.RecordBatch.from_pydict({"s": pa.array([float(statistic(rnd.choices(values, k=total))) for _ in range(chunk)], pa.float64())})

    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if not isinstance(statistic, Fold | Middle):
        every = packed.withColumn("chunk", numbers(chunks))
        return every.repartition(min(chunks, 4 * tasks), "chunk").sortWithinPartitions("chunk", "start").mapInArrow(whole, "s double")
    groups = min(chunks, max(1, -(-2 * tasks // many)))  # tasks that share a block's chunks

    def partial(batches):
        for b in batches:
            for r in b.to_pylist():
                start, n = r["start"], r["n"]
                values = np.frombuffer(r["data"]).reshape(n, -1)
                terms = statistic.parts(values) if isinstance(statistic, Fold) else values
                for c in range(r["group"], chunks, groups):
                    out = np.zeros((chunk, terms.shape[1]))
                    for i, at, places in draws(c, total, chunk):
                        if isinstance(statistic, Middle):
                            if not at <= total // 2 < at + len(places):
                                continue
                            places = places[total // 2 - at : total // 2 - at + 1]
                        if n < total:
                            places = places[(places >= start) & (places < start + n)]
                        out[i] += terms[places - start].sum(0)
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([c] * chunk, pa.int64()), "i": pa.array(range(chunk), pa.int64()), "sums": pa.array([x.tobytes() for x in out], pa.binary())})

    def finished(t: pa.Table) -> pa.Table:
        """The sums of one chunk over its blocks, resample by resample."""
        sums: dict[int, np.ndarray] = {}
        for i, x in zip(t.column("i").to_pylist(), t.column("sums").to_pylist(), strict=True):
            x = np.frombuffer(x)
            sums[i] = sums[i] + x if i in sums else x
        one = (lambda s: statistic.finish(s, total)) if isinstance(statistic, Fold) else (lambda s: s[0])
        return pa.table({"s": pa.array([float(one(s)) for s in sums.values()], pa.float64())})

    units = packed.withColumn("group", numbers(groups)).repartition(min(many * groups, 16 * tasks), "start", "group")
    # a group of 1000 resamples of a chunk has a row a block; salted by resample it stays small for any number of blocks
    parts = units.mapInArrow(partial, "chunk long, i long, sums binary").withColumn("salt", F.col("i") % 8)
    return parts.groupBy("chunk", "salt").applyInArrow(finished, "s double")


def bootstrap_stderr(df: DataFrame, value: str, seq: str, statistic: Fold | Middle | Callable[[list], float], iterations: int = 1000, size: int = BLOCK) -> DataFrame:
    """One row ``stderr``: the sample deviation of the statistic over resamples. Null values take no part; ties of ``seq`` go by value."""
    return resampled(df, F.col(value), [seq], statistic, iterations, size).agg(F.stddev_samp("s").alias("stderr"))
