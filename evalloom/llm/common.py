"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import discard, scratch, shared_dir, written  # noqa: F401  for this subpackage


def spare(name: str, columns: list[str]) -> str:
    """A column name, ``name`` with as many signs as it takes, that isn't among ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_is_held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from: crc32 of the id's decimal text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def held_out(doc_id: int | None) -> bool:
    """The Python form of ``fold_is_held_out``."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def texts(column: pa.Array) -> Iterator[str]:
    """Whole texts of an Arrow column, nulls as the empty text, one Python string at a time."""
    for x in column:
        yield x.as_py() or ""


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``limit`` bytes of ``column`` (one longer value stays whole)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def rows(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``row``: a struct of ``columns``, so that names that clash or hold dots reach an Arrow function as they are."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))


FEW = 100_000  # strata whose counts may be broadcast


def sampled(df: DataFrame, stratum: Column, key: Column, bound: int) -> DataFrame:
    """About ``bound`` rows of each stratum (all of a smaller one), chosen by the hash of ``key``.

    One small aggregate counts the strata and is written; the rows meet their stratum's count by broadcast while there are
    at most ``FEW`` strata, else by a join. Rows with a null stratum take no part.
    """
    name, many = spare("__stratum", df.columns), spare("__many", df.columns)
    rows = df.withColumn(name, stratum.cast("string")).where(F.col(name).isNotNull())
    counts = written(rows.groupBy(name).agg(F.count(F.lit(1)).alias(many)), "strata")
    met = rows.join(F.broadcast(counts) if counts.count() <= FEW else counts, name)
    return met.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(float(1 << 30)) * bound / F.col(many)).select(*[F.col(f"`{c}`") for c in df.columns])


def streamed(index: DataFrame, packs: DataFrame, blocks: int, answer: Callable[[Iterator[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Each block of ``index`` (block, other columns; one row a block) meets all ``packs`` (one binary column, ``queries``).

    No row carries both: a task sorts the rows of its blocks so that a block comes before the packs that go past it, and
    holds one block and one pack at a time. With fewer blocks than tasks a block is sent to several, each with its share of
    the packs. ``answer`` gets rows as dicts, ``queries`` being None for a block.
    """
    spark = index.sparkSession
    tasks = partitions(spark)
    copies = max(1, -(-2 * tasks // blocks))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = index.withColumn("copy", numbers(copies)).withColumn("queries", F.lit(None).cast("binary"))
    asked = packs.select("queries", F.pmod(F.xxhash64("queries"), F.lit(copies)).cast("int").alias("copy")).withColumn("block", numbers(blocks))
    both = held.unionByName(asked, allowMissingColumns=True).repartition(min(blocks * copies, 16 * tasks), "block", "copy")

    def run(batches):
        def rows():
            for b in batches:
                for i in range(b.num_rows):
                    yield {c: b.column(c)[i].as_py() for c in b.schema.names}

        yield from answer(rows())

    return both.sortWithinPartitions("block", "copy", F.col("queries").isNotNull()).mapInArrow(run, schema)


MERGED = 64  # lists of one key that meet in a row at most


def merged_lists(found: DataFrame, parts: int, merge: Callable[[list[bytes]], bytes]) -> DataFrame:
    """v, found: the lists (binary) that ``parts`` blocks (column ``block``) give for one ``v``, merged ``MERGED`` at a time."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names[:-1]), pa.array([merge(x) for x in b.column("found").to_pylist()], pa.binary())], b.schema.names)

    while parts > MERGED:
        parts = -(-parts // MERGED)
        found = found.withColumn("block", F.pmod("block", F.lit(parts)).cast("int")).groupBy("v", "block").agg(F.collect_list("found").alias("found")).mapInArrow(run, "v binary, block int, found binary")
    return found.groupBy("v").agg(F.collect_list("found").alias("found")).mapInArrow(run, "v binary, found binary")


HOT = 1000  # classes that may hold more than one in so many rows


def joined_classes(rows: DataFrame, classes: DataFrame, keys: list[str], many: str) -> DataFrame:
    """``rows`` with the columns of their class; ``classes`` has one row for each value of ``keys`` and its number of rows.

    Of classes with more than a ``HOT``-th of all rows there are fewer than ``HOT``: they are broadcast, so that no task
    gets a class whole. ``classes`` should be a written table.
    """
    total = classes.agg(F.sum(many)).first()[0] or 0
    hot = classes.where(F.col(many) > total // HOT)
    plain = classes.where(F.col(many) <= total // HOT)
    few = F.broadcast(hot.select(*keys))
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(few, keys, "left_anti").join(plain, keys))
