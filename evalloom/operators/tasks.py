"""What tasks do with their documents besides scoring: records of generated answers, queries, and coresets by task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import remove_think
from .relational import kcenter


def question(messages: Column) -> Column:
    """The first system message's content and the first user message's, joined; a missing one is empty."""
    of = lambda role: F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"], F.lit(""))
    return F.concat(of("system"), of("user"))


def generated_record(messages: Column, images: Column, response: Column) -> Column:
    """struct<messages, images>: the conversation with the answer, without its thoughts, as another turn; no turn has a loss yet.

    Images are given by path. All tasks that make records share it.
    """
    turn = lambda role, content: F.struct(role.cast("string").alias("role"), content.cast("string").alias("content"), F.lit(None).cast("double").alias("loss"))
    before = F.transform(F.coalesce(messages, F.array().cast("array<struct<role:string,content:string>>")), lambda m: turn(m["role"], m["content"]))
    paths = F.transform(F.coalesce(images, F.array().cast("array<string>")), lambda p: F.struct(F.lit(None).cast("binary").alias("bytes"), p.alias("path")))
    return F.struct(F.concat(before, F.array(turn(F.lit("assistant"), remove_think(response)))).alias("messages"), paths.alias("images"))


def decontamination_query(docs: DataFrame, text: Column, wanted: bool, query: str | Column | None = None) -> Column:
    """What a document is looked up by in other corpora: its text, a column by name, or an expression; null if not wanted."""
    if not wanted:
        return F.lit(None).cast("string")
    if query is None:
        return text
    return F.col(f"`{query}`") if isinstance(query, str) and query in docs.columns else F.lit(query) if isinstance(query, str) else query


def item_counts(tasks: list[str], counts: list[float]) -> dict[str, int]:
    """How many items each task keeps: one number for all, or one for each."""
    if len(counts) not in (1, len(tasks)):
        raise ValueError("give one number of items for all tasks or one for each")
    return {t: int(n) for t, n in zip(tasks, counts * len(tasks) if len(counts) == 1 else counts, strict=True)}


def open_tasks(tasks: list[str], done: DataFrame, task: str = "task") -> list[str]:
    """The tasks, in order, of which a table has no row yet; only their names are looked up."""
    there = {r[0] for r in done.where(F.col(task).isin(*tasks)).select(task).distinct().collect()}
    return [t for t in tasks if t not in there]


def coresets(df: DataFrame, task: str, key: str, vector: str, counts: dict[str, int]) -> DataFrame:
    """task, key, pick: each task's rows chosen by k-center, as many as it keeps."""
    parts = [kcenter(df.where(F.col(task) == t), key, vector, n).select(F.lit(t).alias("task"), "key", "pick") for t, n in counts.items()]
    return reduce(DataFrame.union, parts) if parts else df.sparkSession.createDataFrame([], "task string, key long, pick int")
