"""The thin queries over this subpackage's operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, covertree, language, licenses, multiindex, packing, permutation, repair, secrets, simhash, spelling, suffix, toxicity
from .common import table


def vocabulary(path: str | None = None) -> str:
    """The JSON text of a tokenizer file; by default the 49k word BPE of the installed public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_permutation_index": lambda s, d: permutation.nearest(table(s, d, "embeddings")),
        "op2_secret_scan": lambda s, d: secrets.find(docs(s, d)),
        "op3_length_buckets": lambda s, d: packing.pack(docs(s, d)),
        "op4_bpe_segment_tree": lambda s, d: bpe.encoded(docs(s, d), vocabulary()),
        "op5_multi_index_hashing": lambda s, d: multiindex.nearest(table(s, d, "embeddings")),
        "op6_ppm_language": lambda s, d: language.language(docs(s, d)),
        "op7_license_rules": lambda s, d: licenses.find(docs(s, d)),
        "op8_suffix_dedup": lambda s, d: suffix.report(docs(s, d)),
        "op9_toxicity_lexicon": lambda s, d: toxicity.toxicity(docs(s, d), table(s, d, "labels")),
        "op10_simhash_vptree": lambda s, d: simhash.near_duplicates(docs(s, d)),
        "op11_structure_repair": lambda s, d: repair.repair(table(s, d, "conversations")),
        "op12_cover_tree": lambda s, d: covertree.near(table(s, d, "embeddings")),
        "op13_spelling_tries": lambda s, d: spelling.variants(docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    """Only the exact search over short codes is within SQL's means on whole tables; the others have brute-force tests."""
    return {
        "op5_multi_index_hashing": """
            WITH v AS (SELECT row_number() OVER () AS id, vec_id, embedding FROM (SELECT DISTINCT vec_id, embedding FROM embeddings) WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                         AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                         AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
                 b AS (SELECT id, vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM v),
                 u AS (SELECT id, vec_id, generate_subscripts(bits, 1) - 1 AS i, unnest(bits) AS bit FROM b),
                 w AS (SELECT id, vec_id, i // 60 AS part, count(*) AS many, sum(CASE WHEN bit THEN 1::BIGINT << (i % 60)::BIGINT ELSE 0 END)::BIGINT AS code FROM u GROUP BY ALL),
                 c AS (SELECT id, vec_id, sum(many) AS size, list(code ORDER BY part) AS code FROM w GROUP BY id, vec_id),
                 p AS (SELECT q.id, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.code, c.code), lambda z: bit_count(xor(z[1], z[2]))))::INTEGER AS distance
                       FROM c AS q, c WHERE q.vec_id % 20 = 0 AND q.id <> c.id AND q.size = c.size),
                 r AS (SELECT query_id, (row_number() OVER (PARTITION BY id ORDER BY distance, vec_id))::INTEGER AS rank, vec_id, distance FROM p)
            SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 20""",
    }
