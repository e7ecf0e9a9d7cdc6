"""Exact top-k search of binary codes by incremental multi-index hashing.

A code has a bit for each component of the vector, padded to whole words of 64 bits. It is cut into segments of 16 bits; the
``m`` segments in which the codes differ have a table each from segment value to codes. A query looks up the values
within radius 0, then 1, ... of its own segment value, one segment after another. Once segment s has been searched with
radius r, every code within m * r + s bits has been met (a code further off in every searched segment is further off in
all); when the distance of the k-th verified code is within that, the result is complete.

Equal codes form one class with the ids of ``TOP`` + 1 of its rows, the smallest. The index is cut into blocks, each searched exactly, while
packs of queries stream past it: a task holds one block and one pack. The nearest of all blocks are the exact result.

Defined results: as for the permutation index, null, zero, non-finite vectors and null ids take no part; rows of one
id with different vectors are queries and candidates of their own, repeated rows count once; vectors of one dimension are
searched among themselves; fewer codes than k give all; ties go to the smaller id.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import merged_lists, streamed, written
from .permutation import TOP, by_dimension, classes, valid
from .suffix import spread

SEGMENT = 16
BLOCK, MOST_BLOCK = 65_536, 1 << 18  # codes in a block, about, from and to
QUERIES = 1024


def sign_codes(rows: DataFrame) -> DataFrame:
    """id and v (8 bytes for each 64 components or part of them): bit i is set if component i is above 0."""

    def run(batches):
        for b in batches:
            v = b.column("v").to_pylist()
            x = np.frombuffer(b"".join(v)).reshape(len(v), -1) > 0
            bits = np.packbits(np.pad(x, ((0, 0), (0, -x.shape[1] % 64))), axis=1, bitorder="little")
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "v": pa.array([r.tobytes() for r in bits], pa.binary())})

    return rows.mapInArrow(run, "id long, v binary")


@lru_cache
def flips(bits: int, radius: int) -> np.ndarray:
    """All masks of ``bits`` bits with just ``radius`` of them set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(bits), radius)], np.uint64)


class MultiIndex:
    """The tables of one block of different codes, given as rows of 64-bit words."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for s in range(codes.shape[1] * 64 // SEGMENT):
            part = self._part(codes, s).astype(np.int64)
            if len(part) and part.min() < part.max():  # any codes further off in all the others are further off
                order = np.argsort(part, kind="stable")
                self.tables.append((s, np.concatenate([[0], np.cumsum(np.bincount(part, minlength=1 << SEGMENT))]), order))

    @staticmethod
    def _part(codes: np.ndarray, s: int) -> np.ndarray:
        word, at = divmod(s * SEGMENT, 64)
        return (codes[..., word] >> np.uint64(at)) & np.uint64((1 << SEGMENT) - 1)

    def _far(self, places: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.codes[places] ^ q).sum(1, dtype=np.int64)

    def nearest(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of all codes at most as far as the k-th nearest one (all codes, if fewer)."""
        n, m = len(self.codes), len(self.tables)
        if not m:
            return np.arange(n), self._far(np.arange(n), q)
        met = np.zeros(n, bool)
        at, far = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for radius in range(SEGMENT + 1):
            for t, (s, edges, order) in enumerate(self.tables):
                values = (self._part(q, s) ^ flips(SEGMENT, radius)).astype(np.int64)
                size = edges[values + 1] - edges[values]
                some = size > 0
                new = order[spread(edges[values[some]], size[some])]
                new = new[~met[new]]
                met[new] = True
                at = np.concatenate([at, new])
                far = np.concatenate([far, self._far(new, q)])
                if len(at) == n or (len(at) >= k and np.partition(far, k - 1)[k - 1] <= m * radius + t):
                    limit = np.partition(far, k - 1)[k - 1] if len(at) >= k else far.max()
                    keep = far <= limit
                    return at[keep], far[keep]
        return at, far


def search(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, distance: the exact ``top`` nearest codes of each row that ``queries`` selects."""
    return by_dimension(valid(df, key, vector).distinct(), lambda rows: _search_rows(sign_codes(rows), queries, top), RESULT)


RESULT = "query_id long, rank int, vec_id long, distance int"


def _search_rows(rows: DataFrame, queries: Column, top: int) -> DataFrame:
    keep = top + 1
    table = written(classes(rows, keep), "codes")
    count = table.count()
    blocks = max(1, -(-count // int(min(MOST_BLOCK, max(BLOCK, count // 64)))))

    def pack(t: pa.Table) -> pa.Table:
        one = lambda x: pa.array([b"".join(x)], pa.binary())
        ids = t.column("ids").to_pylist()
        return pa.table({"block": t.column("block").slice(0, 1), "codes": one(t.column("v").to_pylist()), "sizes": one([np.array([len(x) // 8 for x in ids], np.int32).tobytes()]), "ids": one(ids)})

    dealt = table.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int"))
    index = written(dealt.groupBy("block").applyInArrow(pack, "block int, codes binary, sizes binary, ids binary"), "multi-index")
    asked = rows.where(queries)

    def travel(batches):
        for b in batches:
            v = b.column("v").to_pylist()
            for i in range(0, len(v), QUERIES):
                yield pa.RecordBatch.from_pydict({"queries": pa.array([b"".join(v[i : i + QUERIES])], pa.binary())})

    packed = asked.select("v").distinct().mapInArrow(travel, "queries binary")

    def answer(rows):
        for r in rows:
            if r["queries"] is None:
                ids, sizes = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["sizes"], np.int32)
                made, ends = MultiIndex(np.frombuffer(r["codes"], np.uint64).reshape(len(sizes), -1)), np.cumsum(sizes)
                continue
            q = np.frombuffer(r["queries"], np.uint64).reshape(-1, made.codes.shape[1])
            found = []
            for code in q:
                at, far = made.nearest(code, keep)
                many = sizes[at].astype(np.int64)
                member, value = ids[spread(ends[at] - many, many)], np.repeat(far, many)
                best = np.lexsort((member, value))[:keep]
                found.append(np.stack([value[best], member[best]]).tobytes())
            yield pa.RecordBatch.from_pydict({"v": pa.array([x.tobytes() for x in q], pa.binary()), "block": pa.array([r["block"]] * len(q), pa.int32()), "found": pa.array(found, pa.binary())})

    def merge(parts: list[bytes]) -> bytes:
        far, ids = np.concatenate([np.frombuffer(x, np.int64).reshape(2, -1) for x in parts], axis=1)
        best = np.lexsort((ids, far))[:keep]
        return np.stack([far[best], ids[best]]).tobytes()

    def shown(batches):
        for b in batches:
            out = []
            for q, x in zip(b.column("id").to_pylist(), b.column("found").to_pylist(), strict=True):
                others = np.frombuffer(x, np.int64).reshape(2, -1).T.tolist()
                if [0, q] in others:  # the query's own row; only equal codes have no distance
                    others.remove([0, q])
                out += [(q, k + 1, i, d) for k, (d, i) in enumerate(others[:top])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int32()))], ["query_id", "rank", "vec_id", "distance"])

    best = merged_lists(streamed(index, packed, blocks, answer, "v binary, block int, found binary"), blocks, merge)
    return asked.join(best, "v").select("id", "found").mapInArrow(shown, RESULT)


def nearest(embeddings: DataFrame) -> DataFrame:
    """Query form: queries are the rows whose vec_id is divisible by 20."""
    return search(embeddings, F.col("id") % 20 == 0)
