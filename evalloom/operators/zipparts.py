"""Files in order are dealt to archives by a budget of bytes, without one task that folds the whole list.

A file that would go beyond the budget opens a new part. With running sums S of the sizes, the part that file i opens is
followed by the one that opens at the first file j with S(j) > S(i - 1) + max(budget, size(i)): so a part's start is known by
that limit alone, and the starts form a chain of limits.

1. Files are ordered by ranges and cut into blocks; sums over the blocks (a row each) give each block its base.
2. In a block the chain of starts from any file is followed to where it leaves the block, as a limit. The limits that may leave
   a block are those of its last part's worth of files.
3. Each such limit is taken to the block that it enters, which tells the limit that it leaves with: a small table of steps.
4. The limits that are really met, from the first on, are found by pointer doubling over the steps.
5. A block is met by one limit at most. It marks its starts from there; the numbers of starts before it are sums over blocks.

Files without bytes open a part only just behind a file larger than the budget, so the chain leaves them out. The next file
with bytes then goes into that part, which the chain counts as its own; only if it is itself larger than the budget, the empty
files stay a part of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import discard, written

BLOCK = 4096  # files of a block
KEY = ["__range", "__block"]


def _chain(sizes: np.ndarray, base: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's files with bytes: their sums, the place of the next start (their number, if beyond), the limit for it."""
    ends = base + np.cumsum(sizes)
    limit = ends - sizes + np.maximum(sizes, most)
    return ends, np.searchsorted(ends, limit, side="right"), limit


def _before(df: DataFrame, value: Column, name: str, last: bool = False, after: bool = False) -> DataFrame:
    """``name``: the sum of ``value`` over the blocks before (``last``: the last one that isn't null; ``after``: the first behind).

    No window holds more rows than there are ranges, or blocks in one.
    """
    by = F.desc if after else F.asc
    def fold(c: str, w) -> Column:
        w = w.rowsBetween(Window.unboundedPreceding, -1)
        return F.last(c, ignorenulls=True).over(w) if last else F.coalesce(F.sum(c).over(w), F.lit(0))

    x = df.withColumn("__v", value)
    one = (F.min_by if after else F.max_by)("__v", F.when(F.col("__v").isNotNull(), F.col("__block"))) if last else F.sum("__v")
    ranges = x.groupBy("__range").agg(one.alias("__all")).withColumn("__over", fold("__all", Window.orderBy(by("__range")))).drop("__all")
    within = fold("__v", Window.partitionBy("__range").orderBy(by("__block")))
    both = x.withColumn("__in", within).join(F.broadcast(ranges), "__range")
    joined = F.coalesce("__in", "__over") if last else (F.col("__in") + F.col("__over")).cast("long")
    return both.withColumn(name, joined).drop("__v", "__in", "__over")


def zip_parts(files: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """``files`` (seq, size; null sizes count as 0) with ``part``, from 1."""
    spark, columns = files.sparkSession, files.columns
    ranged = files.withColumn("__size", F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long"))).repartitionByRange("seq").sortWithinPartitions("seq").withColumn("__range", F.spark_partition_id())

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = 0
        for f in frames:
            place = at + np.arange(len(f))
            at += len(f)
            yield f.assign(__block=place // block, __place=place % block)

    schema = T.StructType([*ranged.schema.fields, T.StructField("__block", T.LongType()), T.StructField("__place", T.LongType())])
    placed = written(ranged.mapInPandas(number, schema), "zip-files")
    solid = F.col("__size") > 0
    place = F.when(solid, F.col("__place"))
    sums = placed.groupBy(*KEY).agg(F.sum("__size").alias("bytes"), F.max_by("__size", place).alias("tail"), F.min_by("__size", place).alias("head"), F.max_by("__size", "__place").alias("final"))
    for value, name, after in (("tail", "behind", False), ("final", "just", False), ("head", "next", True)):
        sums = _before(sums, F.col(value), name, last=True, after=after)
    blocks = written(_before(sums, F.col("bytes"), "base"), "zip-blocks")
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    # a number a block; a limit enters the block whose sums it lies among
    bounds = spark.sparkContext.broadcast(np.array(sorted(r["base"] for r in blocks.where("bytes > 0").select("base").toLocalIterator()), np.int64))
    full = placed.where(solid).join(blocks.select(*KEY, "base"), KEY).select("__range", "__block", "__place", "__size", "base")

    def enters(limits: DataFrame) -> DataFrame:
        def run(frames):
            for f in frames:
                yield f.assign(base=bounds.value[np.searchsorted(bounds.value, f["limit"].to_numpy(), side="right") - 1])

        return limits.where(F.col("limit") < total).mapInPandas(run, "limit long, base long")

    def leaving(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("__place")
        ends, after, limit = _chain(f["__size"].to_numpy(), int(f["base"].iloc[0]), most)
        return pd.DataFrame({"limit": limit[after == len(ends)]})

    def step(key, f: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(f) or not len(asked):
            return pd.DataFrame({"limit": [], "to": []}, dtype="int64")
        f = f.sort_values("__place")
        ends, after, limit = _chain(f["__size"].to_numpy(), int(key[0]), most)
        out = limit.copy()
        for i in np.flatnonzero(after < len(ends))[::-1]:
            out[i] = out[after[i]]
        return pd.DataFrame({"limit": asked["limit"], "to": out[np.searchsorted(ends, asked["limit"].to_numpy(), side="right")]})

    first = spark.createDataFrame([(most,)], "limit long")
    limits = full.groupBy(*KEY).applyInPandas(leaving, "limit long").union(first).distinct()
    jump = written(full.groupBy("base").cogroup(enters(limits).groupBy("base")).applyInPandas(step, "limit long, to long"), "zip-steps")
    met, known = written(first, "zip-met"), 1
    while True:
        new = met.join(jump, "limit").select(F.col("to").alias("limit"))
        more = written(met.union(new).distinct(), "zip-met")
        discard(met)
        met, before, known = more, known, more.count()
        if known == before:
            break
        on = jump.select(F.col("limit").alias("to"), F.col("to").alias("further"))
        further = written(jump.join(on, "to").select("limit", F.col("further").alias("to")), "zip-steps")
        discard(jump)
        jump = further
    entry = enters(met).select("limit", F.col("base").alias("__at"))
    marked_blocks = blocks.join(entry, (F.col("base") == F.col("__at")) & (F.col("bytes") > 0), "left").select(*KEY, "base", "limit", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("behind", "just", "next")])

    def opened(f: pd.DataFrame) -> pd.DataFrame:
        """``part``: starts of the block so far; files without bytes that open a part before the chain's next start are in that one."""
        f = f.sort_values("__place")
        size = f["__size"].to_numpy()
        at = np.flatnonzero(size > 0)
        starts, limit = np.zeros(len(f), np.int64), f["limit"].iloc[0]
        if len(at) and limit == limit:
            ends, after, _ = _chain(size[at], int(f["base"].iloc[0]), most)
            i = int(np.searchsorted(ends, int(limit), side="right"))
            while i < len(at):
                starts[at[i]] = 1
                i = int(after[i])
        known = pd.Series(np.where(size > 0, size, np.nan))
        behind, ahead = known.ffill().fillna(f["behind"].iloc[0]).to_numpy(), known.bfill().fillna(f["next"].iloc[0]).to_numpy()
        early = (size == 0) & (behind > most)
        # a part of empty files only, between two files larger than the budget
        starts[early & (ahead > most) & (np.concatenate([[f["just"].iloc[0]], size[:-1]]) > most)] = 1
        f["part"] = np.cumsum(starts) + (early & (ahead <= most))
        f["starts"] = starts
        return f[kept.names]

    kept = T.StructType([*schema.fields, T.StructField("part", T.LongType()), T.StructField("starts", T.LongType())])
    marked = written(placed.join(marked_blocks, KEY).groupBy(*KEY).applyInPandas(opened, kept), "zip-marked")
    ahead = _before(marked.groupBy(*KEY).agg(F.sum("starts").alias("n")), F.col("n"), "ahead").select(*KEY, "ahead")
    return marked.join(ahead, KEY).select(*[F.col(f"`{c}`") for c in columns], (F.col("part") + F.col("ahead") + 1).cast("int").alias("part"))
