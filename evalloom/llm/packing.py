"""Packing into optimal length buckets.

Dynamic programming over the global histogram of lengths chooses the bucket bounds that minimise padding (each text is
padded to its bucket's bound). Token-budget batches form inside each bucket: as many texts as fit the budget at the bound.

A bucket's texts are dealt into shards by hash before they are ordered, so a bucket that holds most rows is never one
task's work; a shard holds ``BATCHES`` batches or more, and its last one may be short. Texts longer than the budget get a
batch each. The hash is of the id and the row's place in the written table, so rows of one id, null ids too, are dealt as well.

Defined results: null and empty texts have length 0 and share the bucket of the shortest; ties in length fall into one
bucket; repeated rows are packed each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BUCKETS, BUDGET = 16, 16_384
LEAST_SHARD, BATCHES = 256, 8  # rows and batches that a shard holds, about, at least


def bounds(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds, ascending, of at most ``buckets`` buckets with the least total padding; exact.

    cost(i, j) = length[j] * (count[j] - count[i]) - (tokens[j] - tokens[i]) for lengths i+1..j: for each number of buckets
    the best i is a lower envelope of lines, queried at rising lengths. O(buckets * lengths).
    """
    lengths = sorted(histogram)
    if not lengths:
        return []
    count, tokens = [0], [0]
    for x in lengths:
        count.append(count[-1] + histogram[x])
        tokens.append(tokens[-1] + x * histogram[x])
    n = len(lengths)
    best = [0] + [lengths[j - 1] * count[j] - tokens[j] for j in range(1, n + 1)]
    cut: list[list[int]] = [[0] * (n + 1)]
    for _ in range(1, min(buckets, n)):
        hull: list[int] = []  # places whose lines -count[i] * x + best[i] + tokens[i] form the envelope
        of = lambda i, x: best[i] + tokens[i] - count[i] * x  # noqa: E731, B023
        new, back, at = [0] * (n + 1), [0] * (n + 1), 0
        for j in range(1, n + 1):
            i = j - 1
            while len(hull) - at >= 2 or len(hull) >= 2:
                a, b = hull[-2], hull[-1]
                # b is nowhere best between a and the new line
                if (best[i] + tokens[i] - best[a] - tokens[a]) * (count[b] - count[a]) <= (best[b] + tokens[b] - best[a] - tokens[a]) * (count[i] - count[a]):
                    hull.pop()
                else:
                    break
            hull.append(i)
            at = min(at, len(hull) - 1)
            x = lengths[j - 1]
            while at + 1 < len(hull) and of(hull[at + 1], x) <= of(hull[at], x):
                at += 1
            back[j] = hull[at]
            new[j] = x * count[j] - tokens[j] + of(hull[at], x)
        best = new
        cut.append(back)
    out, j = [], n
    for back in reversed(cut):
        if j:
            out.append(lengths[j - 1])
            j = back[j]
    return out[::-1]


def padding(histogram: dict[int, int], edges: list[int]) -> int:
    return sum(n * (edges[bisect_left(edges, x)] - x) for x, n in histogram.items())


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens (words), bucket, bucket_length, batch_id, position, for every row.

    The histogram that comes to the driver has one row for each different length.
    """
    length = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long")
    sized = written(docs.select("doc_id", length.alias("n_tokens"), F.monotonically_increasing_id().alias("place")), "lengths")
    histogram = {r[0]: r[1] for r in sized.groupBy("n_tokens").count().collect()}
    edges = bounds(histogram, buckets)
    if not edges:
        return sized.selectExpr("doc_id", "n_tokens", "0 bucket", "0L bucket_length", "'' batch_id", "0 position").where("false")
    held = [0] * len(edges)
    for x, n in histogram.items():
        held[bisect_left(edges, x)] += n
    room = [max(1, budget // max(1, e)) for e in edges]
    shards = [max(1, h // max(LEAST_SHARD, BATCHES * r)) for h, r in zip(held, room, strict=True)]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("bucket") + 1)
    bucket = F.lit(len(edges) - 1)
    for k in range(len(edges) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= edges[k], k).otherwise(bucket)
    dealt = sized.withColumn("bucket", bucket).withColumn("shard", F.pmod(F.xxhash64("doc_id", "place"), of(shards).cast("long")))
    row = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens", "place")) - 1
    ranked = dealt.withColumn("row", row).withColumn("room", of(room))
    return ranked.select("doc_id", "n_tokens", "bucket", of([int(e) for e in edges]).cast("long").alias("bucket_length"), F.concat_ws("-", "bucket", "shard", F.floor(F.col("row") / F.col("room"))).alias("batch_id"), (F.col("row") % F.col("room")).cast("int").alias("position"))
