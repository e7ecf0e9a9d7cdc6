"""Rows of a question-and-answer benchmark that renews itself: generated items, judged scores, selections, published tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import lower_keys
from .relational import keep_last


def items(pages: DataFrame, response: str) -> DataFrame:
    """``pages`` with subtask, question, answer, criteria: one row for each item of a generated JSON answer.

    The answer maps subtasks to lists of items; names of subtasks and keys count in lower case, an item without any of the
    three keys is left out, and an answer that isn't such a map gives no rows.
    """
    by_task = F.from_json(F.col(response), "map<string,array<map<string,string>>>")
    x = pages.select("*", F.explode(by_task).alias("subtask", "__items")).select("*", F.explode("__items").alias("__item"))
    x = x.withColumn("subtask", F.lower("subtask")).withColumn("__item", lower_keys(F.col("__item")))
    keys = ("question", "answer", "criteria")
    for k in keys:
        x = x.withColumn(k, F.try_element_at("__item", F.lit(k)))
    has = F.lit(True)
    for k in keys:
        has = has & F.array_contains(F.map_keys("__item"), k)
    return x.where(has).drop("__items", "__item")


def checked(response: Column) -> Column:
    """struct<question, answer, criteria, subtask> of a checked answer in JSON."""
    return F.from_json(response, "question string, answer string, criteria string, subtask string")


def sections(response: Column) -> Column:
    """struct<question, answer, criteria, subtask> of a text in sections; null for a section that isn't there."""
    part = lambda p: F.when(response.rlike(p), F.trim(F.regexp_extract(response, p, 1)))
    return F.struct(
        part(r"(?is)question:\s*(.*?)\nAnswer:").alias("question"), part(r"(?is)answer:\s*(.*?)\nCriteria").alias("answer"),
        part(r"(?is)criteria:\s*(.*?)\n(?:Subtask:|$)").alias("criteria"), part(r"(?i)subtask:\s*(.*)").alias("subtask"),
    )


def judged(response: Column) -> Column:
    """struct<score, reason> of a judge's JSON answer; of any other text no score, and the text as the reason."""
    r = F.try_parse_json(response)
    score, reason = F.try_variant_get(r, "$.score", "double"), F.try_variant_get(r, "$.reason", "string")
    return F.struct(F.when(r.isNotNull(), score).alias("score"), F.when(r.isNotNull(), reason).otherwise(response).alias("reason"))


def plain_response(v: Column, depth: int = 8) -> Column:
    """The first entry of the first entry ... of a nested list (VARIANT) as text; null is empty."""
    inner = F.coalesce(*[F.try_variant_get(v, "$" + "[0]" * k, "variant") for k in range(depth, 0, -1)], v)
    return F.coalesce(F.try_variant_get(inner, "$", "string"), F.lit(""))


def above(score: Column, least: float) -> Column:
    """Scores above a threshold; none and 0 don't pass."""
    return F.coalesce((score != 0) & (score > least), F.lit(False))


def admitted(score: Column, least: float) -> Column:
    """Scores that reach a threshold, if there is one; none and 0 don't pass then."""
    return F.coalesce((score != 0) & (score >= least), F.lit(False)) if least else F.lit(True)


def selection(rows: DataFrame, column: str, without: str, key: str, seed: int) -> DataFrame:
    """Rows with a value and another id than ``without``, shuffled by a hash of seed and id, so that every run agrees."""
    return rows.where(F.col(column).isNotNull() & (F.col(key) != without)).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def subset(rows: DataFrame, source: str, task: str) -> DataFrame:
    return rows.where(F.col(source) == task)


def relabelled(label: Column, old: str, new: str) -> Column:
    return F.when(label == old, new).otherwise(label)


def literal_field(text: Column, field: str) -> Column:
    """A text value of a Python dict literal; the text is never evaluated."""
    return F.nullif(F.regexp_extract(text, rf"""['"]{field}['"]\s*:\s*['"]([^'"]*)['"]""", 1), F.lit(""))


def published(rows: DataFrame, seq: str, drop: list[str], name: Column) -> DataFrame:
    """Rows renumbered from 0 in order of ``seq`` (column id), without ``drop``, with the subset's name.

    Numbers run over the whole table: a published benchmark is a selection of bounded size.
    """
    return rows.withColumn("id", F.row_number().over(Window.orderBy(seq)) - 1).withColumn("subset", name).drop(*drop)


def refined(rows: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with the new values where there are any, else their own."""
    n = new.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    x = rows.join(n, key, "left")
    return x.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def split_renamed(rows: DataFrame, old: str, new: str | None, column: str = "split") -> DataFrame:
    """One split under another name, or without it."""
    return rows.where(F.col(column) != old) if new is None else rows.withColumn(column, relabelled(F.col(column), old, new))


def appended(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def published_scores(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables as one; of rows with equal keys the later one stays."""
    return keep_last(old.withColumn("__o", F.lit(0)).unionByName(new.withColumn("__o", F.lit(1))), keys, "__o").drop("__o")


def page_information(*parts: Column) -> Column:
    """The parts of a page's information that are there, one a line."""
    return F.concat_ws("\n", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def image_name(subject: Column, key: Column, old: Column) -> Column:
    """``<subject>_<id>`` with the old name's suffix."""
    return F.concat(subject, F.lit("_"), key.cast("string"), F.regexp_extract(old, r"(\.[^./]*)$", 1))


def with_urls(rows: DataFrame, base: str, key: str) -> DataFrame:
    return rows.withColumn("url", F.concat(F.lit(base), F.col(key).cast("string")))


def run_metadata(models: DataFrame, arguments: Column, started: Column, ended: Column) -> DataFrame:
    """``models`` with the model's name out of its arguments (``pretrained=...``, ``model=...``) and the run's seconds."""
    name = F.coalesce(*[F.nullif(F.regexp_extract(arguments, rf"(?:^|,){k}=([^,]*)", 1), F.lit("")) for k in ("pretrained", "peft", "model", "path", "engine")], F.lit(""))
    seconds = (ended.cast("double") - started.cast("double")).alias("seconds")
    return models.withColumn("model_name", name).withColumn("seconds", seconds)


def screens(images: Column) -> Column:
    """Captured pictures as texts for a request."""
    return F.transform(images, F.base64)


def average_length(rows: DataFrame, task: str, length: str) -> DataFrame:
    return rows.groupBy(task).agg(F.avg(length).alias("mean_length"))


def with_images(rows: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """Rows with the pictures of their id; rows without any aren't there."""
    return rows.join(images, key)


def grouped(rows: DataFrame, key: Column, column: str, most: int = 10_000) -> DataFrame:
    """key, values: each key's values in a list; a key with more than ``most`` is split, by ``part``, so no list grows without bound."""
    x = rows.select(key.alias("key"), F.col(column).alias("v"), F.monotonically_increasing_id().alias("i"))
    counts = x.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / most)).cast("int")
    dealt = x.join(counts, "key").withColumn("part", F.pmod(F.xxhash64("i"), parts).cast("int"))
    return dealt.groupBy("key", "part").agg(F.array_sort(F.collect_list("v")).alias("values"))
