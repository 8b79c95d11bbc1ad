"""Structured Streaming forms of the ingestion steps.

Jobs keep what they must remember in the state store (keys that are stored once, running values with their timers) or fold each
micro-batch into rows that can be merged in any order. Results go to the batch's own folder, so a replayed batch overwrites itself
and a result never depends on which rows arrived together. ``base`` is the job's folder: the same
folder continues where the last run stopped, none starts a new job under ``spark.checkpoint.dir``. What is available is
drained; a service starts the same query with a processing-time trigger.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweir import settings as S
from feedweir.operators import articles as A
from feedweir.operators import feeds
from feedweir.operators.health import health_states
from feedweir.session import shared_dir
from feedweir.streaming.state import CONF, MICROS, Fold, folded_in_order


# --- running -----------------------------------------------------------------------------------------
def read_stream(spark: SparkSession, folder: str, file_glob: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream; the number of files per micro-batch bounds its size, not its result."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", file_glob)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def new_base(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_batches(stream: DataFrame, base: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Run ``handle(batch, batch_id)`` for every micro-batch that is available; ``base`` keeps the progress."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _empty(stream: DataFrame) -> DataFrame:
    return stream.sparkSession.createDataFrame([], stream.schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def folded(stream: DataFrame, base: str, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``fold`` makes of each micro-batch, of all batches so far."""
    spark, data = stream.sparkSession, f"{base}/data"
    schema = fold(_empty(stream)).schema
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{data}/batch=-1")
    run_batches(stream, base, lambda batch, i: fold(batch).write.mode("overwrite").parquet(f"{data}/batch={i}"))
    return spark.read.schema(schema).parquet(data)


# --- keys that are stored once -----------------------------------------------------------------------
def insert_once(stream: DataFrame, keys: Sequence[str], base: str | None = None, stored: DataFrame | None = None) -> DataFrame:
    """One row per key of everything that has arrived; ``stored`` holds keys that were there before the job began.

    Keys lie in the state store: a batch looks up its own and reads neither earlier batches nor ``stored``, which enters the state
    with the job's first batch.
    """
    spark = stream.sparkSession
    base = base or new_base(spark, "once")
    data, seed = f"{base}/data", f"{base}/seed"
    for name, value in CONF.items():
        spark.conf.set(name, value)
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{data}/batch=-1")
    rows = stream
    if stored is not None:
        stored.select(*keys).dropDuplicates().write.mode("ignore").parquet(seed)
        known = spark.readStream.schema(stream.select(*keys).schema).parquet(seed)
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema if f.name not in keys]
        rows = stream.withColumn("_stored", F.lit(False)).unionByName(known.select(*keys, *rest, F.lit(True).alias("_stored")))

    def handle(batch: DataFrame, batch_id: int) -> None:
        if stored is not None:
            batch = batch.where("NOT _stored").drop("_stored")
            if batch_id == 0:  # the first batch brings both, in no order
                batch = batch.join(spark.read.parquet(seed), list(keys), "left_anti").select(*stream.columns)
        batch.write.mode("overwrite").parquet(f"{data}/batch={batch_id}")

    run_batches(rows.dropDuplicates(list(keys)), base, handle)
    return spark.read.schema(f"{_ddl(stream)}, batch long").parquet(data).select(*stream.columns)


def dedupe_articles(stream: DataFrame, base: str | None = None, articles: DataFrame | None = None) -> DataFrame:
    """Each URL hash once, but for those of ``articles`` stored before."""
    return insert_once(stream, ["canonical_url_hash"], base, articles)


def deliver_once(stream: DataFrame, base: str | None = None, deliveries: DataFrame | None = None) -> DataFrame:
    """Each (article, subscription, channel) once, but for ``deliveries`` stored before."""
    return insert_once(stream, ["article_id", "subscription_id", "channel"], base, deliveries)


# --- mergeable sums ------------------------------------------------------------------
def domain_rate(stream: DataFrame, limit: int = S.DOMAIN_FETCHES_PER_MINUTE, base: str | None = None) -> DataFrame:
    """Fetches (domain, fetched_at) per domain and minute with the excess over the limit, of all that has arrived."""

    def counts(batch: DataFrame) -> DataFrame:
        return batch.groupBy("domain", F.date_trunc("minute", "fetched_at").alias("minute")).agg(F.count("*").alias("n"))

    parts = folded(stream, base or new_base(stream.sparkSession, "rate"), counts)
    total = parts.groupBy("domain", "minute").agg(F.sum("n").alias("n"))
    return total.select("domain", "minute", "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("over_limit"))


# --- keyed state with timers -------------------------------------------------------------------------
def _seconds(interval: float) -> int:
    return int(interval * MICROS)


#: Generations that share a state: each has a few events only.
KEYS_TOGETHER = 128


class _Watch(Fold):
    schema = "status string, pending_since long, timed_out boolean"

    def __init__(self, timeout: int):
        self.timeout = timeout

    def step(self, state, event):
        pending = event["status"] in S.PENDING_STATUSES
        told = bool(state and state["told"])
        if not pending and not told:
            return None, []  # done: nothing is left to wait for
        return {"since": event["at"], "pending": pending, "told": told}, []

    def due(self, state):
        return state["since"] + self.timeout if state["pending"] and not state["told"] else None

    def wake(self, state, clock):
        return state | {"told": True}, [("failed", state["since"], True)]


def watchdog(
    stream: DataFrame, now: Column, timeout_seconds: int = S.GENERATION_TIMEOUT_SECONDS, base: str | None = None, late: str = "1 day"
) -> DataFrame:
    """A failed event, once, for each generation (id, status, at) that is still pending ``timeout_seconds`` after its last status.

    It is given out as soon as the clock has passed the deadline, while the stream goes on.
    """
    timeout = max(S.GENERATION_TIMEOUT_FLOOR, timeout_seconds)
    base = base or new_base(stream.sparkSession, "watchdog")
    told = folded_in_order(stream, "id", "at", ["status"], _Watch(_seconds(timeout)), base, late, now, KEYS_TOGETHER)
    return told.select(F.col("key").alias("id"), "status", F.timestamp_micros("pending_since").alias("pending_since"), "timed_out")


class _Fresh(Fold):
    schema = "at long, fresh boolean"

    def __init__(self, minutes: int):
        self.span = _seconds(60 * minutes)

    def step(self, state, event):
        at = event["at"]
        if state is None:
            return {"last": at}, [(at, True)]
        if at <= state["last"] + self.span:
            return {"last": max(at, state["last"])}, []
        return {"last": at}, [(state["last"] + self.span, False), (at, True)]

    def due(self, state):
        return state["last"] + self.span

    def wake(self, state, clock):
        return None, [(state["last"] + self.span, False)]


def freshness(stream: DataFrame, now: Column, minutes: int = S.FRESH_MINUTES, base: str | None = None, late: str = "1 day") -> DataFrame:
    """Turns of sources by their successes (source_id, at): fresh with one, stale when ``minutes`` pass without another.

    One row per turn, given out when the clock has passed it. A stale source holds no state.
    """
    turns = folded_in_order(stream, "source_id", "at", ["at"], _Fresh(minutes), base or new_base(stream.sparkSession, "freshness"), late, now)
    return turns.select(F.col("key").alias("source_id"), F.timestamp_micros("at").alias("at"), "fresh")


class _Health(Fold):
    schema = "health_score int, consecutive_failures int, last_status string, last_http_status int"
    tie = "id"

    def step(self, state, event):
        score, fails = (state["score"], state["fails"]) if state else (S.HEALTH_START, 0)
        if event["status"] == "success":
            score, fails = min(S.HEALTH_MAX, max(S.HEALTH_FLOOR, score) + S.HEALTH_GAIN), 0
        else:
            drop = S.HEALTH_SOFT_DROP if event["error_type"] in S.HEALTH_SOFT_ERRORS else S.HEALTH_HARD_DROP
            score, fails = max(0, score - drop), fails + 1
        return {"score": score, "fails": fails, "status": event["status"], "http": event["http_status"]}, []

    def after(self, state):
        return [(state["score"], state["fails"], state["status"], state["http"])]


def running_health(stream: DataFrame, base: str | None = None, late: str = "1 day") -> DataFrame:
    """Score, failures and state per source after the attempts that have arrived, in the order in which they happened.

    The score is the state: a batch gives out one row per source that it touches, and the log is neither kept nor read again.
    """
    decided = stream.where(F.col("status").isin("success", "failed"))
    columns = ["id", "status", "error_type", "http_status"]
    told = folded_in_order(decided, "source_id", "started_at", columns, _Health(), base or new_base(stream.sparkSession, "health"), late)
    fields = [c.split()[0] for c in _Health.schema.split(", ")]
    latest = told.groupBy(F.col("key").alias("source_id")).agg(F.max_by(F.struct(*fields), "batch").alias("h")).select("source_id", "h.*")
    states = health_states(latest).select("source_id", "health_state")
    return latest.select("source_id", "health_score", "consecutive_failures").join(states, "source_id")


class _Changes(Fold):
    schema = "id long, status string, at long"
    tie = "id"

    def step(self, state, event):
        changed = state is None or state["status"] != event["status"]
        return {"status": event["status"]}, [(event["id"], event["status"], event["at"])] if changed else []


def status_changes(stream: DataFrame, base: str | None = None, late: str = "1 day") -> DataFrame:
    """Status rows (source_id, id, status, at) that differ from the source's previous one in event order, given out as the stream runs."""
    told = folded_in_order(stream, "source_id", "at", ["id", "status"], _Changes(), base or new_base(stream.sparkSession, "status"), late)
    return told.select(F.col("key").alias("source_id"), "id", "status", F.timestamp_micros("at").alias("at"))


# --- the ingestion chain -----------------------------------------------------------------------------
def normalized_payloads(payloads: DataFrame) -> DataFrame:
    """Payloads → parsed → normalised articles; ``row`` orders them by payload and position."""
    row = F.concat_ws("-", F.lpad(F.col("payload_id").cast("string"), 19, "0"), F.lpad(F.col("pos").cast("string"), 9, "0"))
    return A.normalize_articles(feeds.item_rows(feeds.parsed(payloads), "source_id").withColumn("row", row))


def _keys(articles: DataFrame) -> DataFrame:
    """Both hashes of articles as (prefix, kind, hash) rows."""
    pairs = F.explode(F.array(
        F.struct(F.lit("url").alias("kind"), F.col("canonical_url_hash").alias("hash")),
        F.struct(F.lit("content").alias("kind"), F.col("content_hash").alias("hash")),
    ))
    return articles.select(pairs.alias("k")).select(F.substring("k.hash", 1, 2).alias("prefix"), "k.kind", "k.hash")


def ingest(payload_stream: DataFrame, articles: DataFrame | None = None, base: str | None = None) -> DataFrame:
    """Append the new articles of every micro-batch to the job's table and return it.

    ``articles`` are those stored before the job began. Their hashes and those of later batches lie in folders by prefix;
    a batch reads the folders of its own hashes, never the articles.
    """
    spark = payload_stream.sparkSession
    base = base or new_base(spark, "ingest")
    data, keys = f"{base}/data", f"{base}/keys"
    empty = A.detect_new_articles(normalized_payloads(_empty(payload_stream)), spark.createDataFrame([], "canonical_url_hash string, content_hash string"), "row")
    schema = empty.schema
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{data}/batch=-1")
    seed = articles.select("canonical_url_hash", "content_hash") if articles is not None else empty
    _keys(seed).write.mode("ignore").partitionBy("prefix").parquet(f"{keys}/batch=-1")

    def handle(batch: DataFrame, batch_id: int) -> None:
        work = f"{base}/work/batch={batch_id}"
        normalized_payloads(batch).write.mode("overwrite").parquet(work)
        rows = spark.read.parquet(work)
        touched = [r[0] for r in _keys(rows).select("prefix").distinct().collect()]  # at most 256
        known = spark.read.schema("kind string, hash string, prefix string, batch long").option("basePath", keys).parquet(keys)
        known = known.where((F.col("batch") != batch_id) & F.col("prefix").isin(touched))
        stored = known.select(
            F.when(F.col("kind") == "url", F.col("hash")).alias("canonical_url_hash"),
            F.when(F.col("kind") == "content", F.col("hash")).alias("content_hash"),
        )
        new = A.detect_new_articles(rows, stored, "row").select(*schema.names)
        new.write.mode("overwrite").parquet(f"{data}/batch={batch_id}")
        made = spark.read.schema(schema).parquet(f"{data}/batch={batch_id}")
        _keys(made).write.mode("overwrite").partitionBy("prefix").parquet(f"{keys}/batch={batch_id}")

    run_batches(payload_stream, base, handle)
    return spark.read.schema(schema).parquet(data)
