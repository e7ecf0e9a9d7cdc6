"""Scans: lenient JSON lines, annotation trees, result logs, ground-truth documents, expected counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import partitions_by_size


def json_records(spark: SparkSession, path: str | list[str], whole: bool = False) -> DataFrame:
    """file, record (VARIANT): one row for each JSON object; broken lines and non-objects are left out.

    ``whole`` reads files that hold one JSON array (or object), however it is laid out.
    """
    lines = spark.read.text(path, wholetext=whole, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("record"))
    if whole:
        kind = F.schema_of_variant("record")
        rows = F.when(kind.startswith("ARRAY"), F.try_variant_get("record", "$", "array<variant>")).otherwise(F.array("record"))
        lines = lines.select("file", F.explode(rows).alias("record"))
    return lines.where(F.col("record").isNotNull() & F.schema_of_variant("record").startswith("OBJECT"))


def broken_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, value of the lines that ``json_records`` leaves out."""
    x = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), "value", F.try_parse_json("value").alias("r"))
    return x.where((F.trim("value") != "") & (F.col("r").isNull() | ~F.schema_of_variant("r").startswith("OBJECT"))).select("file", "value")


def annotation_tree(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """path, doc (VARIANT) of every JSON file below a folder."""
    x = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    return x.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc")).where("doc is not null")


def with_ground_truth(samples: DataFrame, documents: DataFrame, path: str = "gt_json_path") -> DataFrame:
    """Samples with their document (null if there is none): one scan of the documents and one join."""
    return samples.join(documents.select(F.col("path").alias(path), "doc"), path, "left")


def first_field(doc: Column, *paths: str, kind: str = "string") -> Column:
    """The first path that is there: raw annotations before copies; an empty list counts as there."""
    return F.coalesce(*[F.try_variant_get(doc, p, kind) for p in paths])


def run_info(path: Column) -> Column:
    """struct<round, family, model> of a result path .../<round>/<family>/<model>.jsonl."""
    parts = F.split(path, "/")
    part = lambda i: F.try_element_at(parts, F.lit(i))
    return F.struct(part(-3).alias("round"), part(-2).alias("family"), F.regexp_replace(part(-1), r"\.jsonl?$", "").alias("model"))


def result_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(summary, samples) of a log whose lines have a ``kind``; older logs hold a top-level ``samples`` list."""
    x = json_records(spark, path)
    kind = F.try_variant_get("record", "$.kind", "string")
    old = x.where(kind.isNull()).select(F.explode(F.try_variant_get("record", "$.samples", "array<variant>")).alias("record"))
    return x.where(kind == "summary").select("record"), x.where(kind == "sample").select("record").union(old)


def expected_counts(spark: SparkSession, path: str) -> DataFrame:
    """grain, key, n from a JSON file of optional maps."""
    x = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("r"))
    parts = [x.select(F.lit("overall").alias("grain"), F.lit("overall").alias("key"), F.try_variant_get("r", "$.overall", "long").alias("n")).where("n is not null")]
    for g in ("category", "type", "group"):
        parts.append(x.select(F.lit(g).alias("grain"), F.explode(F.try_variant_get("r", f"$.by_{g}", "map<string,long>")).alias("key", "n")))
    return reduce(DataFrame.union, parts)


def with_split(frames: dict[str, DataFrame]) -> DataFrame:
    """All splits together, each row with its split's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("split", F.lit(s)) for s, f in frames.items()])


def spread(df: DataFrame, key: str, small: int = 64 << 20) -> DataFrame:
    """Deals a small scan by ``key`` over the session's shuffle partitions; a larger one has splits enough and stays.

    One row group is one task however many cores there are, so rows that are costly to compute go to all of them. Only
    the size that the file listing tells decides; the rows are the same either way.
    """
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key) if size < small else df


def dealt(df: DataFrame, key: str, part: int = 1 << 20) -> DataFrame:
    """Deals a scan of narrow rows that are costly to compute by ``key``, whatever its size: a partition for each ``part`` bytes.

    A file may be a single row group, and a split has hundreds of thousands of such rows; so the number of partitions grows with
    the listed size, and is the session's shuffle partitions at least.
    """
    return df.repartition(partitions_by_size(df, part), key)


READERS = {".jsonl": "json", ".json": "json", ".csv": "csv", ".parquet": "parquet", ".orc": "orc", ".txt": "text"}


def any_table(spark: SparkSession, path: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """A data set by its suffix (a folder without one is Parquet), without its media columns ``drop``."""
    suffix = next((s for s in READERS if path.rstrip("/").endswith(s)), ".parquet")
    reader = spark.read.option("header", "true") if suffix == ".csv" else spark.read.option("multiLine", suffix == ".json")
    return reader.format(READERS[suffix]).load(path).drop(*drop)


def media_free(df: DataFrame) -> DataFrame:
    """Without columns of bytes, alone or in structs with a path."""
    media = [f.name for f in df.schema.fields if f.dataType.typeName() == "binary" or (f.dataType.typeName() == "struct" and {"bytes", "path"} <= set(f.dataType.names))]
    return df.drop(*media)


def files(spark: SparkSession, root: str, pattern: str = "*", skip: tuple[str, ...] = ()) -> DataFrame:
    """path and size of the files below a folder, without those in folders named ``skip``; contents aren't read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", F.col("length").alias("size"))
    parts = F.split("path", "/")
    return x.where(~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, skip)))) if skip else x


def result_files(spark: SparkSession, root: str, rounds: list[str] | None = None, families: list[str] | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """path, round, family, model of the result files below a folder, of the wanted rounds and families."""
    x = files(spark, root, "*.jsonl", skip).select("path", run_info(F.col("path")).alias("i")).select("path", "i.*")
    x = x.where(F.col("round").isin(*rounds)) if rounds else x
    return x.where(F.col("family").isin(*families)) if families else x


def first_found(spark: SparkSession, patterns: list[str]) -> str | None:
    """The first path, by pattern and then by name, that any of the patterns matches; None if none does."""
    jvm = spark.sparkContext._jvm
    for p in patterns:
        path = jvm.org.apache.hadoop.fs.Path(p)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        names = sorted(s.getPath().toString() for s in found) if found is not None else []
        if names:
            return names[0]
    return None


def merged_samples(spark: SparkSession, root: str) -> DataFrame:
    """record (VARIANT), response: all lines of the sample files below a folder; nested responses are opened."""
    from ..operators.benchrows import plain_response

    x = json_records(spark, f"{root}/*_samples_*.json")
    return x.select("file", "record", plain_response(F.try_variant_get("record", "$.response", "variant")).alias("response"))


def truth_file(truth: Column) -> Column:
    """The path in a sample's ground truth (VARIANT): a text, or the first entry of a list."""
    return F.coalesce(F.try_variant_get(truth, "$.gt_json_path[0]", "string"), F.when(F.schema_of_variant(F.try_variant_get(truth, "$.gt_json_path", "variant")) == "STRING", F.try_variant_get(truth, "$.gt_json_path", "string")))


def truth_field(doc: Column, own: Column, *names: str) -> Column:
    """A field of ground truth (VARIANT): of the document's texts, else of its masks, else of the sample itself.

    Of several names the first that is there counts.
    """
    there = lambda v: F.when(v.isNotNull() & (F.schema_of_variant(v) != "VOID"), v)
    return F.coalesce(*[there(F.try_variant_get(d, f"$.{p}{n}", "variant")) for n in names for d, p in ((doc, "text_annotation."), (doc, "mask_annotation."), (own, ""))])


def websites(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """url, subject, screens of configured websites."""
    return spark.createDataFrame([(r["url"], r.get("subject"), int(r.get("screens", 1))) for r in rows], "url string, subject string, screens int")


def npy_vectors(spark: SparkSession, root: str, pattern: str = "*.npy") -> DataFrame:
    """path, row, vector of the rows of all array files below a folder; an inner dimension of one goes, a single vector is a row.

    A file is read by one task, as its format has no parts, and leaves it in batches of rows.
    """
    import io

    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                if x.ndim == 3 and x.shape[1] == 1:
                    x = x[:, 0]
                x = np.atleast_2d(x)
                if x.ndim != 2:
                    raise ValueError(f"{path} holds an array of {x.ndim} dimensions")
                for i in range(0, len(x), 1024):
                    part = x[i : i + 1024].astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(range(i, i + len(part)), pa.int64()), pa.array(list(part), pa.list_(pa.float64()))], ["path", "row", "vector"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "content").mapInArrow(run, "path string, row long, vector array<double>")
