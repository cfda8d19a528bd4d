"""Mixing sources to target weights: whole repeats plus one hash-seeded Bernoulli copy.

Words are counted per source, a water level over the few source rows gives each source its target, and every document
is taken ``floor(rate)`` times plus once more with probability equal to the fraction. The draw is a hash of id, text
and seed, so reruns and lost executors give the same rows.

Null or empty texts have size 0 and are taken 0 words (their rows are repeated like others). A null source is a source
of its own, ordered last. Null ids draw by their text alone; rows that repeat both id and text draw alike. An empty table
gives no rows. Other columns are passed on; the names beginning with ``mix_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from driftlake.llm.common import ready, saved

#: Words a document may be repeated up to, and the weights that sources take in turn.
MOST_REPEATS, WEIGHTS, SEED = 3, (1, 2, 3), "mix-1"

_WORD = r"[^\x20\x09-\x0D]+"
SPARK = {
    "size": r"regexp_count(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')",
    "hex": "CAST(conv(substring({0}, 1, 8), 16, 10) AS DOUBLE)",
    "same": "<=>",
}
DUCKDB = {
    "size": f"len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))",
    "hex": "CAST(('0x' || substring({0}, 1, 8))::BIGINT AS DOUBLE)",
    "same": "IS NOT DISTINCT FROM",
}


def _sizes(d: dict) -> str:
    return f"""SELECT source, CAST(sum({d['size']}) AS BIGINT) AS source_size FROM {{docs}} GROUP BY source"""


def _targets(d: dict) -> str:
    """Sources with size, target and rate. Sorted by cap over weight, those below the water level are capped."""
    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {} {} END".format(
        len(WEIGHTS), " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    )
    return f"""
WITH sized AS ({_sizes(d)}),
weighed AS (SELECT source, source_size, CAST({weight} AS DOUBLE) AS weight FROM sized),
capped AS (SELECT *, {MOST_REPEATS} * CAST(source_size AS DOUBLE) AS cap, {MOST_REPEATS} * source_size / weight AS ratio FROM weighed),
levels AS (
  SELECT *,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped),
leveled AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS water FROM levels)
SELECT source, source_size, weight, least(cap, weight * water) AS target,
       CASE WHEN source_size > 0 THEN least({MOST_REPEATS}, weight * water / source_size) ELSE 0 END AS rate
FROM leveled"""


def _taken(d: dict) -> str:
    """Documents with their number of copies."""
    draw = d["hex"].format(f"md5(concat('{SEED}:', coalesce(CAST(doc_id AS STRING), ''), ':', md5(coalesce(text, ''))))")
    return f"""CAST(floor(mix_rate) + CASE WHEN {draw} / 4294967296 < mix_rate - floor(mix_rate) THEN 1 ELSE 0 END AS INT)"""


def source_targets(docs: DataFrame) -> DataFrame:
    """Columns source, source_size, weight, target, rate: one row per source."""
    return docs.sparkSession.sql(_targets(SPARK), docs=docs)


def with_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with mix_size, mix_target, mix_rate of the source, and mix_copies of the document."""
    spark = ready(docs.sparkSession)
    # one row per source, written so that the planner knows its size before it picks a join
    rates = saved(source_targets(docs), "rates")
    return spark.sql(
        f"""SELECT *, {_taken(SPARK)} AS mix_copies FROM (
          SELECT d.*, r.source_size AS mix_size, r.target AS mix_target, r.rate AS mix_rate
          FROM {{docs}} d JOIN {{rates}} r ON d.source <=> r.source)""",
        docs=docs, rates=rates,
    )


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with every row as often as the mix takes it."""
    spark = docs.sparkSession
    columns = ", ".join(f"`{c}`" for c in docs.columns)
    return spark.sql(f"SELECT {columns} FROM {{taken}} LATERAL VIEW explode(sequence(1, mix_copies)) AS mix_copy WHERE mix_copies > 0", taken=with_copies(docs))


def mix_report(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.sql(
        f"""SELECT doc_id, CAST(size AS BIGINT) AS size, mix_size AS source_size, mix_target AS target,
                   CAST(size * mix_copies AS BIGINT) AS taken, mix_copies AS copies, source
            FROM (SELECT *, {SPARK['size']} AS size FROM {{taken}})""",
        taken=with_copies(docs.select("doc_id", "text", "source")),
    )


ORACLE = f"""
WITH rates AS ({_targets(DUCKDB).replace('{docs}', 'documents')}),
sized AS (SELECT d.doc_id, d.text, d.source, r.source_size, r.target, r.rate AS mix_rate, {DUCKDB['size']} AS size
          FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
taken AS (SELECT *, {_taken(DUCKDB)} AS copies FROM sized)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies, source FROM taken
"""
