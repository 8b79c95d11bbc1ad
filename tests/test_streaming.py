"""Stream results do not depend on how rows are dealt into files and micro-batches."""

from __future__ import annotations

import datetime as dt
import json
import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from feedweir.operators.crawl import domain_rate_window
from feedweir.operators.health import health_scores, health_states
from feedweir.streaming import jobs, state

FILES = 8


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each micro-batch opens the state of every partition."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(params=["backward", "shuffled"])
def dealt(request, spark, tmp_path):
    """Write rows (ordered by time) into eight files that arrive in some order, one per micro-batch; → stream."""

    def deal(rows: list[tuple], schema: str):
        order = list(range(FILES))
        if request.param == "backward":
            order.reverse()
        elif request.param == "shuffled":
            random.Random(3).shuffle(order)
        folder = str(tmp_path / "in")
        os.makedirs(folder)
        size = -(-len(rows) // FILES)
        stamp = time.time() - 1000
        for turn, i in enumerate(order):
            part = str(tmp_path / f"part{i}")
            spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.parquet(part)
            name = next(n for n in os.listdir(part) if n.startswith("part-") and n.endswith(".parquet"))
            os.rename(f"{part}/{name}", f"{folder}/{turn}.parquet")
            os.utime(f"{folder}/{turn}.parquet", (stamp + turn, stamp + turn))
        return jobs.read_stream(spark, folder, "*.parquet", schema, files_per_trigger=1)

    return deal


ATTEMPT = "source_id bigint, id bigint, status string, error_type string, http_status int, started_at timestamp"


def attempts(spark):
    draw = random.Random(5)
    rows = []
    for i in range(240):
        at = f"2024-01-{1 + i // 24:02d} {i % 24:02d}:{draw.randrange(60):02d}:00"
        status = draw.choice(["success", "failed", "failed", "running"])
        rows.append((i % 3, i, status, draw.choice(["timeout", "http_403"]), draw.choice([200, 403, 500]), at))
    frame = spark.createDataFrame(rows, ATTEMPT.replace("timestamp", "string")).withColumn("started_at", F.col("started_at").cast("timestamp"))
    return sorted(map(tuple, frame.collect()), key=lambda r: r[5])


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_delivery_once_keeps_every_key(spark, dealt):
    rows = [(i % 37, i % 5, "telegram", f"2024-{1 + i // 40:02d}-01") for i in range(400)]
    stream = dealt(rows, "article_id bigint, subscription_id bigint, channel string, day string")
    found = [tuple(r)[:3] for r in jobs.deliver_once(stream).collect()]
    assert len(found) == len(set(found)) and set(found) == {r[:3] for r in rows}


def test_health_equals_batch(spark, dealt):
    rows = attempts(spark)
    health = health_scores(spark.createDataFrame(rows, ATTEMPT))
    want = health.select("source_id", "health_score", "consecutive_failures").join(health_states(health).select("source_id", "health_state"), "source_id")
    same(jobs.running_health(dealt(rows, ATTEMPT), late="30 days"), want)


def test_status_changes_equal_replay(spark, dealt):
    rows = attempts(spark)
    last, want = {}, []
    for r in rows:
        if last.get(r[0]) != r[2]:
            want.append((r[0], r[1], r[2]))
        last[r[0]] = r[2]
    stream = dealt(rows, ATTEMPT).withColumnRenamed("started_at", "at")
    assert sorted(tuple(r)[:3] for r in jobs.status_changes(stream, late="30 days").collect()) == sorted(want)


def test_rate_equals_batch(spark, dealt):
    rows = attempts(spark)
    frame = spark.createDataFrame(rows, ATTEMPT).withColumnRenamed("started_at", "fetched_at")
    sources = spark.createDataFrame([(i, f"h{i}.example") for i in range(3)], "id bigint, host string")
    stream = dealt(rows, ATTEMPT).select(F.concat(F.lit("h"), F.col("source_id"), F.lit(".example")).alias("domain"), F.col("started_at").alias("fetched_at"))
    same(jobs.domain_rate(stream), domain_rate_window(frame, sources))


def turns(rows, minutes, now):
    """Turns of each source from a plain walk through its successes."""
    out, span = [], dt.timedelta(minutes=minutes)
    for source in {r[0] for r in rows}:
        at = sorted(r[5] for r in rows if r[0] == source and r[2] == "success")
        for before, t in zip([None, *at], at, strict=False):
            if before is None or t > before + span:
                out += [] if before is None else [(source, before + span, False)]
                out.append((source, t, True))
        if at and at[-1] + span < now:
            out.append((source, at[-1] + span, False))
    return sorted(out)


def test_freshness_gives_every_turn_once(spark, dealt):
    rows, now = attempts(spark), dt.datetime(2024, 1, 10, 12)
    stream = dealt(rows, ATTEMPT).where("status = 'success'").select("source_id", F.col("started_at").alias("at"))
    fresh = jobs.freshness(stream, F.lit("2024-01-10 12:00:00").cast("timestamp"), 300, late="30 days")
    assert sorted(map(tuple, fresh.collect())) == turns([r for r in rows if r[5] <= now], 300, now)


def test_watchdog_gives_each_stale_generation_once(spark, dealt):
    start, rows = dt.datetime(2024, 1, 1), []
    for i in range(40):
        at = start + dt.timedelta(hours=i)
        rows.append((i, "queued", at))
        if i % 3:
            rows.append((i, ["fetching", "ready"][i % 2], at + dt.timedelta(seconds=100 if i % 5 else 900)))
    rows.sort(key=lambda r: r[2])
    now = start + dt.timedelta(hours=38, seconds=120)
    got = jobs.watchdog(dealt(rows, "id long, status string, at timestamp"), F.lit(str(now)).cast("timestamp"), 180, late="30 days").collect()
    last = {i: (at, status) for i, status, at in rows}
    want = {i: at for i, (at, status) in last.items() if status != "ready" and at + dt.timedelta(seconds=180) < now}
    assert {r.id: r.pending_since for r in got} == want and len(got) == len(want) and all(r.status == "failed" and r.timed_out for r in got)


def one_file_per_batch(spark, tmp_path, parts: list[list[tuple]], schema: str):
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    for i, rows in enumerate(parts):
        part = str(tmp_path / f"part{i}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        name = next(n for n in os.listdir(part) if n.startswith("part-") and n.endswith(".parquet"))
        os.rename(f"{part}/{name}", f"{folder}/{i}.parquet")
        os.utime(f"{folder}/{i}.parquet", (time.time() - 1000 + i,) * 2)
    return jobs.read_stream(spark, folder, "*.parquet", schema, files_per_trigger=1)


def test_timers_fire_while_the_stream_goes_on(spark, tmp_path):
    """A deadline that passes is told in the batch whose events move the clock beyond it; a late answer changes nothing then."""
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    parts = [[(1, "queued", at(0)), (2, "queued", at(1))], [(2, "ready", at(3)), (3, "queued", at(30))], [(4, "ready", at(60))], [(1, "ready", at(2)), (5, "queued", at(61))]]
    base = str(tmp_path / "job")
    stream = one_file_per_batch(spark, tmp_path, parts, "id long, status string, at timestamp")
    jobs.watchdog(stream, F.lit(str(at(61))).cast("timestamp"), 180, base, late="5 minutes").collect()
    told = {r.key: r.batch for r in spark.read.parquet(f"{base}/data").collect()}
    assert set(told) == {1, 3} and told[1] < told[3] < 4


class Store:
    """A state store in memory that counts how often it is asked."""

    def __init__(self):
        self.calls, self.rows, self.value, self.timers = 0, [], None, []

    def getListState(self, name, schema):
        return Cell(self, "rows")

    def getValueState(self, name, schema):
        return Cell(self, "value")

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


class Cell:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def _held(self):
        self.store.calls += 1
        return getattr(self.store, self.name)

    def _put(self, held):
        self.store.calls += 1
        setattr(self.store, self.name, held)

    def get(self):
        return self._held()

    def exists(self):
        return self._held() is not None

    def appendList(self, rows):
        self._put(self.store.rows + rows)

    put = update = _put

    def clear(self):
        self._put([] if self.name == "rows" else None)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_keys_that_share_a_state_ask_the_store_together():
    """The rows are those of a state of their own, at each clock; the store is asked a few times for all of them."""
    draw, second = random.Random(3), jobs.MICROS
    events = [(k, draw.randrange(0, 1000) * second, draw.choice(["queued", "fetching", "ready"])) for k in range(100) for _ in range(draw.randint(1, 3))]
    draw.shuffle(events)
    batches = [events[:90], events[90:]]

    def run(make, group):
        stores, told = {}, []
        for i, batch in enumerate(batches):
            clock, work = Clock(400_000 + 700_000 * i), {}
            for k, at, status in batch:
                work.setdefault(group(k), []).append((at, json.dumps({"key": k, "status": status})))
            for g in {**dict.fromkeys(stores), **work}:
                fold = make(jobs._Watch(180 * second), ["key", "status", "pending_since", "timed_out"])
                fold.init(stores.setdefault(g, Store()))
                if g in work:
                    fold.handleInputRows((g,), iter([pd.DataFrame(work[g], columns=["at", "event"])]), clock)
                due, fold.handle.timers = [t for t in fold.handle.timers if t <= clock.ms], [t for t in fold.handle.timers if t > clock.ms]
                for _ in due:
                    told += [(i, *r) for frame in fold.handleExpiredTimer((g,), clock, None) for r in frame.itertuples(index=False, name=None)]
        return sorted(told), sum(s.calls for s in stores.values())

    alone, calls = run(state._Processor, lambda k: k)
    shared, fewer = run(state._Together, lambda k: k // 128)
    assert shared == alone and len(alone) > 20 and {i for i, *_ in alone} == {0, 1}
    assert fewer < 40 < 400 < calls


def test_no_event_is_lost_however_late(spark, tmp_path):
    """A failure that comes days late is counted when it comes: after what was folded before, before what still waited."""
    event = lambda d, ok: (1, d, "success" if ok else "failed", None if ok else "http_5xx", 200 if ok else 500, dt.datetime(2024, 1, d))
    parts = [[event(9, True)], [event(10, True)], [event(12, True)], [event(1, False)]]
    (r,) = jobs.running_health(one_file_per_batch(spark, tmp_path, parts, ATTEMPT), late="1 hour").collect()
    state, fold = None, jobs._Health()
    for d in (9, 1, 10, 12):
        state, _ = fold.step(state, {"status": "failed" if d == 1 else "success", "error_type": "http_5xx", "http_status": 200})
    assert (r.health_score, r.consecutive_failures) == (state["score"], 0)


def test_keys_stored_before_are_left_out(spark, tmp_path):
    parts = [[(f"{i}", i) for i in range(0, 6)], [(f"{i}", i) for i in range(3, 9)], [(f"{i}", i) for i in range(12)]]
    stored = spark.createDataFrame([("2",), ("7",), ("2",), ("99",)], "canonical_url_hash string")
    got = jobs.dedupe_articles(one_file_per_batch(spark, tmp_path, parts, "canonical_url_hash string, n int"), articles=stored).collect()
    assert sorted(int(r[0]) for r in got) == [0, 1, 3, 4, 5, 6, 8, 9, 10, 11]


def test_a_job_continues_where_it_stopped(spark, tmp_path):
    schema, folder, base = "canonical_url_hash string, n int", str(tmp_path / "in"), str(tmp_path / "job")
    spark.createDataFrame([(f"{i % 6}", i) for i in range(12)], schema).write.parquet(folder)
    read = lambda: jobs.read_stream(spark, folder, "*.parquet", schema, files_per_trigger=1)
    assert jobs.dedupe_articles(read(), base).count() == 6
    spark.createDataFrame([(f"{i % 9}", i) for i in range(12)], schema).write.mode("append").parquet(folder)
    found = [r[0] for r in jobs.dedupe_articles(read(), base).collect()]
    assert sorted(found) == [str(i) for i in range(9)]


def test_a_table_may_be_one_file_or_a_folder_of_files(spark, tmp_path):
    from feedweir.plans import bound

    docs = spark.createDataFrame([(i, f"Story {i} " + "x" * i, "en", "s") for i in range(1, 41)], "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    (tmp_path / "folder").mkdir()
    (tmp_path / "file").mkdir()
    docs.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    docs.toPandas().to_parquet(tmp_path / "file" / "documents.parquet")
    for name in ("stream_dedupe", "stream_ingest"):
        folder, file = (sorted(tuple(r) for r in bound(name)(spark, str(tmp_path / kind)).collect()) for kind in ("folder", "file"))
        assert folder == file and len(folder) > 10
