"""Requests and responses as rows: building, repeating, ordering, batching, answering, restoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import numbered, places


def choice_requests(docs: DataFrame, delimiter: str = " ", mutual_info: bool = False) -> DataFrame:
    """doc_id, idx, context, continuation: one request for each choice of (doc_id, context, choices).

    For mutual information each choice is asked again without its context; the first ones keep their numbers.
    """
    x = docs.select("doc_id", "context", F.posexplode("choices").alias("idx", "choice"))
    asked = x.select("doc_id", "idx", "context", F.concat(F.lit(delimiter), F.col("choice")).alias("continuation"), F.lit(False).alias("dry"))
    return asked.union(x.select("doc_id", "idx", F.lit(""), "choice", F.lit(True))) if mutual_info else asked


def context_requests(docs: DataFrame, delimiter: str = " ") -> DataFrame:
    """As ``choice_requests`` for documents whose choices are contexts of one target."""
    return docs.select("doc_id", F.posexplode("choices").alias("idx", "context"), F.concat(F.lit(delimiter), F.col("target")).alias("continuation"))


def repeated(requests: DataFrame, times: Column) -> DataFrame:
    """Each request ``times`` times, numbered by ``repeat`` from 0; none for 0."""
    return requests.select("*", F.explode(F.filter(F.sequence(F.lit(0), F.greatest(times, F.lit(1)) - 1), lambda i: i < times)).alias("repeat"))


def by_document(docs: DataFrame, responses: DataFrame) -> DataFrame:
    """``docs`` with their responses (doc_id, idx, response) in order of ``idx``; documents without any aren't there."""
    rows = responses.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "response"))).alias("r"))
    return docs.join(rows, "doc_id").withColumn("responses", F.transform("r", lambda x: x["response"])).drop("r")


def answer(requests: DataFrame, respond: Callable[[list[dict]], list[str]], batch: int = 64) -> DataFrame:
    """``requests`` with ``response``: a responder gets lists of ``batch`` requests; Arrow batches, no shuffle."""
    import pandas as pd

    schema = T.StructType([*requests.schema.fields, T.StructField("response", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = f.to_dict("records")
            out = [r for i in range(0, len(rows), batch) for r in respond(rows[i : i + batch])]
            yield f.assign(response=out)

    return requests.mapInPandas(run, schema)


def echo(requests: list[dict]) -> list[str]:
    """The responder of tests: the context reversed."""
    return [str(r.get("context") or "")[::-1] for r in requests]


def longest_first(requests: DataFrame, length: str, size: int, seq: str = "seq") -> DataFrame:
    """``requests`` with ``place`` (longest first, ties by ``seq``) and ``batch``; no task sorts all rows."""
    placed = places(requests, F.desc(length), F.asc(seq))
    return placed.withColumn("batch", F.floor(F.col("place") / size))


def restored(rows: DataFrame) -> DataFrame:
    """Reordered rows in their first order, without the places."""
    return rows.drop("place", "batch").orderBy("seq")


def disambiguated(rows: DataFrame, by: list[str], name: str, seq: str) -> DataFrame:
    """Second and further rows of one name within ``by`` as ``name-1``, ``name-2``, ...; a name may have any number of rows."""
    n = F.col("__n")
    x = numbered(rows, [*by, name], seq, name="__n")
    return x.withColumn(name, F.when(n > 0, F.concat(F.col(name), F.lit("-"), n.cast("string"))).otherwise(F.col(name))).drop("__n")


def balanced(rows: DataFrame, by: str, seq: str, k: int) -> DataFrame:
    """The first ``k`` rows of each class, in order of ``seq``; others leave before the shuffle."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(seq))).where(F.col("__r") <= k).drop("__r")


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def finished(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is done; any number of rows of ``done`` may have it."""
    return rows.join(done.select(key).distinct(), key, "left_semi")


def duplicates(members: DataFrame, item: str, group: str) -> DataFrame:
    """Items in more than one group, with their groups."""
    return members.groupBy(item).agg(F.array_sort(F.collect_set(group)).alias("groups")).where(F.size("groups") > 1)


def deduplicated_in_order(values: DataFrame, value: str, seq: str) -> DataFrame:
    """Each value with its first place."""
    return values.groupBy(value).agg(F.min(seq).alias(seq))
