"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

_RUN_KEY = secrets.token_hex(32)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extraction import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepiece_codec import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import taken

    return taken(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .language_id import identify

    return identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def pii_key(spark: SparkSession) -> str:
    """The secret that the setting spark.ternary_rules.piiKey holds; where it is unset, one that is
    drawn for this process, and so for this run only."""
    return spark.conf.get("spark.ternary_rules.piiKey", None) or _RUN_KEY


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replace_pii

    return replace_pii(table(spark, sf_dir, "documents"), pii_key(spark)).select("doc_id", "text", "n_replaced")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup

    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_language_id": op4_language_id,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_simhash": op6_simhash,
    "op7_line_dedup": op7_line_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_top_k": op9_top_k,
    "op10_sentencepiece": op10_sentencepiece,
}
_FINITE = "len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))

#: For DuckDB. Mixing draws, surrogates, the language model, the tokenizers, XXH64 fingerprints and
#: HTML are beyond SQL; tests hold those queries against brute force or the library.
ORACLE_SQL: dict[str, str] = {
    "op3_embedding_dedup": f"""WITH RECURSIVE v AS (
      SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
      WHERE label IS NOT NULL AND {_FINITE} AND len([x FOR x IN embedding IF x <> 0]) > 0),
    links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    reach(u, v) AS (SELECT u, v FROM links UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
    n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u), c AS (SELECT u, min(v) AS least FROM reach GROUP BY u)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id <= coalesce(c.least, vec_id) AS kept
    FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN c ON c.u = vec_id""",
    "op7_line_dedup": f"""WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM split),
    keyed AS (SELECT *, translate(trim(line, {_BLANK}), '{_UPPER}', '{_LOWER}') AS k FROM lines),
    held AS (SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
    kept AS (SELECT keyed.*, keeper IS NULL OR keeper = doc_id AS stays FROM keyed LEFT JOIN held ON keyed.k = held.k)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '')) AS kept_sha256
    FROM kept GROUP BY doc_id""",
    "op9_top_k": f"""WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings WHERE {_FINITE}),
    scored AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
}
