"""Table scans with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# the sample tables, as they lie in Parquet
SAMPLE_TABLES = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
    "o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "region": "r_regionkey INT, r_name STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

# the domain's own tables
ENTITY_TABLES = {
    "sources": "id BIGINT, source_url_hash STRING, source_url STRING, canonical_url_hash STRING, canonical_url STRING, "
    "domain STRING, host STRING, source_type STRING, status STRING, usage_state STRING, health_score INT, health_state STRING, "
    "consecutive_failures INT, polling_interval_minutes INT, last_fetched_at TIMESTAMP, last_parsed_at TIMESTAMP, "
    "last_success_at TIMESTAMP, last_attempt_at TIMESTAMP, next_check_at TIMESTAMP, latest_content_hash STRING, meta STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP",
    "source_aliases": "id BIGINT, source_id BIGINT, alias_url STRING, normalized_alias_url STRING, normalized_alias_hash STRING, "
    "first_seen_at TIMESTAMP, last_seen_at TIMESTAMP",
    "source_fetches": "id BIGINT, source_id BIGINT, fetched_url_hash STRING, fetched_url STRING, http_status INT, etag STRING, "
    "last_modified STRING, content_hash STRING, payload_bytes BIGINT, fetched_at TIMESTAMP, response_headers MAP<STRING,ARRAY<STRING>>",
    "source_snapshots": "id BIGINT, source_id BIGINT, parse_attempt_id BIGINT, snapshot_kind STRING, html_snapshot STRING, "
    "final_url STRING, content_hash STRING, captured_at TIMESTAMP",
    "parse_attempts": "id BIGINT, source_id BIGINT, parser_schema_id BIGINT, stage STRING, status STRING, http_status INT, "
    "error_type STRING, error_message STRING, response_time_ms INT, retry_count INT, used_browser BOOLEAN, used_ai BOOLEAN, "
    "started_at TIMESTAMP, finished_at TIMESTAMP, context STRING",
    "parser_schemas": "id BIGINT, source_id BIGINT, version INT, strategy_type STRING, schema_payload STRING, "
    "confidence_score DECIMAL(5,2), validation_score DECIMAL(5,2), created_by STRING, is_active BOOLEAN, is_shadow BOOLEAN, "
    "last_validated_at TIMESTAMP",
    "articles": "id BIGINT, source_id BIGINT, external_id STRING, canonical_url_hash STRING, canonical_url STRING, "
    "content_hash STRING, title STRING, summary STRING, image_url STRING, published_at TIMESTAMP, discovered_at TIMESTAMP, "
    "normalized_payload STRING, created_at TIMESTAMP",
    "subscriptions": "id BIGINT, user_id BIGINT, source_id BIGINT, channel STRING, target_hash STRING, is_active BOOLEAN, "
    "translate_enabled BOOLEAN, translate_language STRING, last_delivered_at TIMESTAMP, created_at TIMESTAMP",
    "deliveries": "id BIGINT, article_id BIGINT, subscription_id BIGINT, channel STRING, status STRING, attempts INT, "
    "error_message STRING, queued_at TIMESTAMP, delivered_at TIMESTAMP, failed_at TIMESTAMP",
    "translated_articles": "id BIGINT, article_id BIGINT, language STRING, slug STRING, title STRING, content_html STRING, "
    "original_url STRING, image_url STRING, translated_at TIMESTAMP",
    "feed_generations": "id BIGINT, user_id BIGINT, source_id BIGINT, requested_url STRING, resolved_url STRING, "
    "source_type STRING, status STRING, preview_items STRING, meta STRING, started_at TIMESTAMP, finished_at TIMESTAMP, "
    "created_at TIMESTAMP, updated_at TIMESTAMP",
    "webhook_integrations": "id BIGINT, user_id BIGINT, channel STRING, url_hash STRING, label STRING, created_at TIMESTAMP",
    "telegram_chats": "id BIGINT, owner_user_id BIGINT, telegram_chat_id STRING, chat_type STRING, title STRING, "
    "bot_is_member BOOLEAN, bot_membership_status STRING, added_by_telegram_user_id STRING, linked_at TIMESTAMP",
    "failed_jobs": "id BIGINT, payload STRING, exception STRING, failed_at TIMESTAMP",
    "payloads": "payload_id BIGINT, source_id BIGINT, final_url STRING, source_type STRING, content_type STRING, body STRING",
}


def scan_tables(spark: SparkSession, folder: str, schemas: dict[str, str] = SAMPLE_TABLES) -> dict[str, DataFrame]:
    """One lazy DataFrame per table; the declared schema spares a footer pass and pins the types."""
    return {name: spark.read.schema(ddl).parquet(f"{folder}/{name}.parquet") for name, ddl in schemas.items()}


def columns_of(ddl: str) -> list[tuple[str, str]]:
    """(name, type) of each column of a declared schema."""
    return [(name, kind.lower()) for name, kind in (column.split(" ", 1) for column in ddl.split(", "))]


def kind_of(kind: str) -> str:
    """What a column's mass is made of: whole numbers, real numbers, texts, times or lists."""
    if kind.startswith("array"):
        return "list"
    return {"string": "text", "double": "real", "float": "real", "timestamp": "time", "timestamp_ntz": "time"}.get(kind, "whole")


def profiles(loaded: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, n_rows, n_nulls, mass: what each column of each table holds, in one pass per table.

    ``mass`` does not depend on the order of rows and adds up over parts: the sum of whole numbers, of thousandths, of bytes, of
    microseconds (modulo a prime) or of list lengths. A profile before and after a load tells whether rows were lost or changed.
    """
    mass = {
        "whole": lambda c: c.cast("decimal(38,0)"), "real": lambda c: F.floor(c * 1000), "text": F.octet_length,
        "time": lambda c: F.unix_micros(c.cast("timestamp")) % 1000003, "list": F.size,
    }
    out = None
    for name, df in loaded.items():
        sums = []
        for f in df.schema:
            value = F.col(f"`{f.name}`")
            total = F.sum(F.when(value.isNotNull(), mass[kind_of(f.dataType.simpleString())](value)))
            sums.append(F.struct(
                F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"), F.count("*").alias("n_rows"),
                (F.count("*") - F.count(value)).alias("n_nulls"), F.coalesce(total.cast("bigint"), F.lit(0).cast("bigint")).alias("mass"),
            ))
        rows = df.agg(F.array(*sums).alias("columns")).select(F.inline("columns"))
        out = rows if out is None else out.unionByName(rows)
    return out


def scan_jdbc(spark: SparkSession, url: str, table: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """Range-partitioned read of a relational table by its ``id``."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn="id", lowerBound=str(lower), upperBound=str(upper),
                 numPartitions=str(partitions), **options)
        .load()
    )
