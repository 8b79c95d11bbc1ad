"""Queries over the extraction-schema registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweir.operators import health, schemas
from feedweir.plans.registry import query
from feedweir.plans.views import NOW, now_column

ACTIVE = """act AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id DESC) AS rn FROM v_schemas WHERE is_active) x
    WHERE rn = 1)"""


@query("active_schema", f"WITH {ACTIVE} SELECT source_id, id, version, strategy_type FROM act")
def active_schema(v):
    return schemas.active_schema(v.schemas).select("source_id", "id", "version", "strategy_type")


@query(
    "next_schema_version",
    """SELECT s.id AS source_id, CAST(coalesce(max(version), 0) + 1 AS BIGINT) AS next_version FROM v_sources s
        LEFT JOIN v_schemas p ON p.source_id = s.id GROUP BY 1""",
)
def next_schema_version(v):
    return schemas.next_schema_version(v.sources, v.schemas)


@query(
    "activate_schema",
    f"""WITH {ACTIVE}, cand AS (SELECT id AS source_id, CASE source_type WHEN 'rss' THEN 'deterministic_rss' WHEN 'atom' THEN 'deterministic_atom'
            WHEN 'json_feed' THEN 'deterministic_json_feed' ELSE 'deterministic_feed' END AS strategy,
            CASE WHEN id % 4 = 0 THEN NULL ELSE round((id % 100) / 100.0::DOUBLE * 100, 2) END AS score,
            CASE WHEN id % 3 <> 0 THEN '{{"source": ' || id || '}}' END AS payload FROM v_sources),
        p AS (SELECT c.*, act.id AS active_id, coalesce(act.strategy_type = c.strategy, false) AS refresh,
            (SELECT max(version) FROM v_schemas z WHERE z.source_id = c.source_id) AS top FROM cand c LEFT JOIN act ON act.source_id = c.source_id)
        SELECT s.id, s.source_id, s.version, strategy_type,
            CASE WHEN hit AND refresh THEN coalesce(payload, schema_payload) ELSE schema_payload END AS schema_payload,
            CASE WHEN hit AND refresh THEN coalesce(score, confidence_score) ELSE confidence_score END AS confidence_score,
            CASE WHEN hit AND refresh THEN coalesce(validation_score, score) ELSE validation_score END AS validation_score,
            CASE WHEN hit AND NOT refresh THEN false ELSE is_active END AS is_active, CASE WHEN hit AND refresh THEN false ELSE is_shadow END AS is_shadow,
            CASE WHEN hit AND refresh THEN {NOW} ELSE last_validated_at END AS last_validated_at
        FROM (SELECT s.*, p.payload, p.score, p.refresh, coalesce(p.active_id = s.id, false) AS hit FROM v_schemas s LEFT JOIN p ON p.source_id = s.source_id) s
        UNION ALL SELECT NULL, source_id, CAST(coalesce(top, 0) + 1 AS BIGINT), strategy, payload, score, score, true, false, {NOW} FROM p WHERE NOT refresh""",
)
def activate_schema(v):
    candidates = v.sources.select(
        F.col("id").alias("source_id"),
        "source_type",
        F.when(F.col("id") % 4 != 0, F.col("id") % 100 / 100.0).alias("confidence"),
        F.when(F.col("id") % 3 != 0, F.concat(F.lit('{"source": '), F.col("id").cast("string"), F.lit("}"))).alias("schema_payload"),
    )
    return schemas.activate_schema(v.schemas, candidates, now_column())


def _sel(part):
    return f"nullif(trim(coalesce(schema_payload ->> '{part}_xpath', schema_payload ->> '{part}_selector', '')), '') IS NULL"


@query(
    "validate_schema_shape",
    "SELECT id, len(e) = 0 AS valid, array_to_string(e, ' ') AS errors FROM (SELECT id, list_filter(["
    + ", ".join(f"CASE WHEN {_sel(p)} THEN 'Missing or invalid {p}_xpath/{p}_selector.' END" for p in ("article", "title", "link"))
    + "], lambda x: x IS NOT NULL) AS e FROM v_schemas) s",
)
def validate_schema_shape(v):
    return schemas.validate_schema_shape(v.schemas)


@query(
    "score_schema_on_snapshots",
    """WITH r AS (SELECT id AS snapshot_id, schema_id, run_at AS captured_at, avg_score % 13 AS item_count, greatest(avg_score % 13 - id % 4, 0) AS valid_items
            FROM v_validations), n AS (SELECT *, row_number() OVER (PARTITION BY schema_id ORDER BY captured_at DESC, snapshot_id DESC) AS rn FROM r),
        s AS (SELECT schema_id, CASE WHEN item_count = 0 THEN 0 ELSE least(100, CAST(round(valid_items / item_count * 70) AS INT)
            + CASE WHEN valid_items >= 3 THEN least(30, valid_items * 5) ELSE CAST(round(valid_items / 3 * 30) AS INT) END) END AS score FROM n WHERE rn <= 3)
        SELECT schema_id, CAST(round(sum(score) / count(*)) AS INT) AS avg_score, count(*) AS snapshots FROM s GROUP BY 1""",
)
def score_schema_on_snapshots(v):
    results = v.validations.select(
        F.col("id").alias("snapshot_id"), "schema_id", F.col("run_at").alias("captured_at"), (F.col("avg_score") % 13).alias("item_count"),
        F.greatest(F.col("avg_score") % 13 - F.col("id") % 4, F.lit(0)).alias("valid_items"),
    )
    return schemas.score_schema_on_snapshots(results)


@query(
    "shadow_activation",
    """WITH r AS (SELECT *, avg_score >= 70 AS ok, row_number() OVER (PARTITION BY schema_id ORDER BY run_at, id) AS rn FROM v_validations),
        g AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY schema_id ORDER BY rn) AS island FROM r),
        s AS (SELECT schema_id, island, count(*) FILTER (ok) AS streak FROM g GROUP BY 1, 2)
        SELECT s.schema_id, arg_max(streak, island)::INT AS success_runs, max(streak) >= 2 AS activated,
            (SELECT arg_max(avg_score, rn) FROM r WHERE r.schema_id = s.schema_id) AS validation_score FROM s GROUP BY 1""",
)
def shadow_activation(v):
    return health.shadow_activation(v.validations)


@query(
    "schemas_due_revalidation",
    f"""SELECT id AS schema_id, source_id, last_validated_at FROM v_schemas p WHERE is_active AND NOT is_shadow
        AND strategy_type IN ('deterministic_html_schema', 'ai_xpath_schema') AND (last_validated_at IS NULL OR last_validated_at <= {NOW} - INTERVAL '12' HOUR)
        AND EXISTS (SELECT 1 FROM v_sources s WHERE s.id = p.source_id AND s.source_type = 'html' AND s.usage_state = 'active')
        ORDER BY last_validated_at NULLS FIRST, id LIMIT 50""",
)
def schemas_due_revalidation(v):
    return schemas.schemas_due_revalidation(v.schemas, v.sources, now_column())


@query(
    "rollback_empty_schema",
    """WITH latest AS (SELECT source_id, max(id) AS schema_id FROM v_schemas GROUP BY 1),
        prev AS (SELECT p.source_id, max(p.id) AS previous_id FROM v_schemas p JOIN latest l ON l.source_id = p.source_id AND p.id < l.schema_id GROUP BY 1),
        t AS (SELECT l.schema_id, previous_id, l.source_id % 7 AS parsed_count FROM latest l LEFT JOIN prev ON prev.source_id = l.source_id)
        SELECT s.id, s.source_id, CASE WHEN s.id IN (SELECT schema_id FROM t WHERE parsed_count < 4) THEN false
            WHEN s.id IN (SELECT previous_id FROM t WHERE parsed_count < 4) THEN true ELSE is_active END AS is_active,
            CASE WHEN s.id IN (SELECT schema_id FROM t WHERE parsed_count < 4) THEN true
            WHEN s.id IN (SELECT previous_id FROM t WHERE parsed_count < 4) THEN false ELSE is_shadow END AS is_shadow FROM v_schemas s""",
)
def rollback_empty_schema(v):
    ids = v.schemas.select("source_id", "id")
    latest = ids.groupBy("source_id").agg(F.max("id").alias("schema_id"))
    previous = (
        ids.join(latest, "source_id").where("id < schema_id").groupBy("source_id").agg(F.max("id").alias("previous_id"))
    )
    trials = latest.join(previous, "source_id", "left").select(
        "schema_id", "previous_id", (F.col("source_id") % 7).alias("parsed_count")
    )
    return schemas.rollback_empty_schema(v.schemas, trials, min_items=4).select("id", "source_id", "is_active", "is_shadow")


@query(
    "listing_schema_fallback",
    """SELECT page_id, contains(h, '<article') OR n >= 10 AS valid, CASE WHEN contains(h, '<article') THEN 0.58::DOUBLE ELSE 0.41::DOUBLE END AS confidence,
        CASE WHEN contains(h, '<article') THEN '//article[.//a[@href]]' ELSE '//main//*[self::article or self::li or self::div][.//a[@href]]' END AS article_rule
        FROM (SELECT page_id, lower(html) AS h, (length(html) - length(replace(lower(html), '<a ', ''))) / 3 AS n FROM v_pages) p""",
)
def listing_schema_fallback(v):
    return schemas.listing_schema_fallback(v.pages)
