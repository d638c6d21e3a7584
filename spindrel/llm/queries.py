"""The queries of this subpackage: each applies its operator to the whole of its tables."""

from __future__ import annotations

import secrets
import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindrel.llm import bpe, contamination, line_dedup, lm, pii, quality, sharding, simhash, substring, toxicity
from spindrel.llm.common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


#: Where the cluster sets no ``spindrel.pii.key``, pseudonyms hold for this process alone.
_KEY = secrets.token_hex(32)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spindrel.pii.key", _KEY)
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=key)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_FOLD = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_FOLDED = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_FOLDED}, []) AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_FOLDED} AS w FROM benchmark WHERE text IS NOT NULL),
k AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS k FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n)),
m AS (SELECT DISTINCT r, i, n, item FROM g JOIN k USING (n, k)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
_SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM f),
p AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
l AS (SELECT doc_id, count(*) AS n_left, string_agg(word, ' ' ORDER BY p) AS s FROM p ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_left, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN l USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express.  Merges, learned models, fingerprints by XXH64, components and
    pseudonyms are tested against plain versions instead."""
    return {"op2_decontamination": _DECONTAMINATION, "op3_substring_dedup": _SUBSTRINGS}
