"""Relations that the queries derive from the given tables, in both dialects: (Spark, DuckDB)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_SUBS = "SELECT * FROM (VALUES (1, '', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)), (2, 'click', 0e0, 0e0, 300e0, 60e0), (3, 'view,purchase', CAST(NULL AS DOUBLE), NULL, NULL, NULL), (4, '', 100e0, 20e0, 220e0, 50e0)) AS t(sub_id, names, sx0, sz0, sx1, sz1)"
_BANDS = "SELECT * FROM (VALUES ('alpine', 10e0, 60e0, 10e0, 0e0, 90e0, 5e0), ('forest', -50e0, 10e0, 10e0, 0e0, 45e0, 5e0), ('shore', -45e0, -20e0, 0e0, 0e0, 20e0, 3e0)) AS t(biome, lo_e, hi_e, band_e, lo_s, hi_s, band_s)"
_KEYS = "CASE user_id % 7 WHEN 0 THEN 'active_tris' WHEN 1 THEN 'resident_texture_mb' WHEN 2 THEN 'draw_calls' WHEN 3 THEN 'active_jobs' WHEN 4 THEN 'cpu_pages' WHEN 5 THEN 'gpu_pages' ELSE 'asset_cache_mb' END"

#: Where the dialects agree there is one text.
RELATIONS: dict[str, str | tuple[str, str]] = {
    "points": (
        "SELECT vec_id AS id, CAST(element_at(embedding, 1) AS DOUBLE) * 100e0 AS x, CAST(element_at(embedding, 2) AS DOUBLE) * 100e0 AS z FROM {embeddings}",
        "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 100e0 AS x, CAST(embedding[2] AS DOUBLE) * 100e0 AS z FROM {embeddings}",
    ),
    "grid": (
        "SELECT CAST(id div 32 AS INT) AS r, CAST(id % 32 AS INT) AS c, CAST(((id div 32) * 37 + (id % 32) * 101) % 97 AS DOUBLE) AS h FROM range(1024)",
        "SELECT CAST(range // 32 AS INT) AS r, CAST(range % 32 AS INT) AS c, CAST(((range // 32) * 37 + (range % 32) * 101) % 97 AS DOUBLE) AS h FROM range(1024)",
    ),
    "places": "SELECT p_partkey AS id, p_size * 2e0 - 40e0 AS elev, (p_retailprice - 900e0) * 0.9e0 AS slope FROM {part}",
    "bands": _BANDS,
    "deps": "SELECT p_partkey AS key, CAST(floor(p_partkey / 2) AS BIGINT) AS depends_on FROM {part} WHERE p_partkey > 1",
    "artifacts": "SELECT p_partkey AS key, CAST(p_size * 1000 AS BIGINT) AS size_bytes, p_retailprice AS last_access FROM {part}",
    "usage": f"SELECT event_id AS id, event_type AS system, {_KEYS} AS key, CAST(floor(value) AS BIGINT) AS value, ts FROM {{events}}",
    "budgets": "SELECT * FROM (VALUES ('active_tris', 20000), ('draw_calls', 1000000), ('active_jobs', 50), ('gpu_pages', 90000), ('unused', 7)) AS t(key, budget)",
    "changes": "SELECT event_id AS id, event_type AS source, user_id * 10e0 AS x0, floor(value) * 1e0 AS z0, user_id * 10e0 + 15e0 AS x1, floor(value) * 1e0 + 15e0 AS z1 FROM {events}",
    "subscriptions": _SUBS,
    "cameras": (
        "SELECT event_id div 100 AS frame, max_by(user_id, event_id) * 10e0 AS x, max_by(value, event_id) AS z FROM {events} GROUP BY 1",
        "SELECT event_id // 100 AS frame, arg_max(user_id, event_id) * 10e0 AS x, arg_max(value, event_id) AS z FROM {events} GROUP BY 1",
    ),
    "candidates": "SELECT doc_id AS id, doc_id % 5 AS slot, CASE WHEN quality = 1 AND toxic = 0 THEN 'A' WHEN quality = 1 THEN 'B' WHEN toxic = 0 THEN 'C' WHEN toxic = 1 THEN 'D' END AS grade, doc_id % 17 / 850e0 AS seam, 6e0 + doc_id % 23 AS periodic, doc_id % 11 / 10e0 AS rich FROM {labels}",
    "samples": "SELECT l_linenumber AS img, l_discount * 9e0 AS v FROM {lineitem}",
    "pixels": "SELECT CAST(floor(p_partkey / 256) AS BIGINT) AS img, CAST(floor(p_partkey % 256 / 16) AS INT) AS r, CAST(p_partkey % 16 AS INT) AS c, CAST(p_partkey * 7 % 256 AS INT) AS red, CAST(p_size * 5 % 256 AS INT) AS green, CAST(floor(p_retailprice) % 256 AS INT) AS blue FROM {part}",
    "versions": "SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN '0.' || CAST(p_size % 4 AS VARCHAR(9)) || '.1' WHEN 1 THEN '1.2.3-beta.1' WHEN 2 THEN '2.x.1' WHEN 3 THEN CAST(p_size % 3 AS VARCHAR(9)) || '.4.0' WHEN 4 THEN '1.2' ELSE '1.10.0' END AS version FROM {part}",
}
RELATIONS["versions"] = tuple(RELATIONS["versions"].replace("VARCHAR(9)", kind) for kind in ("STRING", "VARCHAR"))


def text(name: str, dialect: int) -> str:
    found = RELATIONS[name]
    return found if isinstance(found, str) else found[dialect]


def named_in(sql: str) -> list[str]:
    return [t for t in TABLES if f"{{{t}}}" in sql]


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = text(name, 0)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in named_in(sql)})


def with_relations(body: str, dialect: int) -> str:
    """A query over relations, with those it names (and what they name) as common tables."""
    used = [n for n in RELATIONS if re.search(rf"\b(?:FROM|JOIN|,)\s*{n}\b", body)]
    head = ", ".join(f"{n} AS ({text(n, dialect)})" for n in used)
    joined = f"WITH RECURSIVE {head}, " if dialect and body.lstrip().upper().startswith("WITH RECURSIVE") else f"WITH {head}, "
    if body.lstrip().upper().startswith("WITH "):
        body = re.sub(r"^\s*WITH (RECURSIVE )?", "", body, flags=re.I)
        sql = joined + body if head else "WITH " + body
    else:
        sql = f"WITH {head} {body}" if head else body
    return sql


def duck_sql(body: str) -> str:
    sql = with_relations(body, 1)
    return sql.format(**{t: t for t in named_in(sql)}) if named_in(sql) else sql
