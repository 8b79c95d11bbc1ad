"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered in id order without a global sort in one task: a range partitioning, numbers inside each partition, and the row
counts of the partitions before. The row number is split into two digits of bases a and b with a * b just above the row
count; rounds of modular additions permute the digit pairs, and a number that lands beyond the row count is sent through
the rounds again (cycle walking). Row number, seed and row count give a row's shard and slot by arithmetic alone.

Edge cases: a null id sorts first, equal ids by checksum and size of their text, repeated rows in any order (their answers differ
only in which of the equal rows gets which); a null text has size 1 and checksum 0; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedweir.llm.scratch import Scratch

SHARDS = 8
SEED = 2024
ROUNDS = 6
PRIME = (1 << 31) - 1
#: Walks after which a number is surely inside: fewer than 64 numbers lie outside up to 4,096 rows, and beyond that at most one in 64.
WALKS = 65


def keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Round keys from a seed: steps of a linear congruence modulo PRIME."""
    out, x = [], (seed * 48271 + 11) % PRIME
    for _ in range(2 * rounds):
        x = (x * 48271 + 12345) % PRIME
        out.append(x)
    return list(zip(out[::2], out[1::2], strict=True))


def bases(rows: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    return a, max(1, -(-rows // a))


def permutation(number: str, rows: int, seed: int) -> str:
    """SQL of the permuted row number of ``number`` (0 <= number < rows)."""
    a, b = bases(rows)
    rounds = ", ".join(
        f"named_struct('c', {c}L, 'm', {m}L, 'base', {a if i % 2 == 0 else b}L)" for i, (c, m) in enumerate(keys(seed))
    )
    once = (
        f"aggregate(array({rounds}), named_struct('x', x div {b}L, 'y', x % {b}L), "
        "(s, k) -> named_struct('x', s.y, 'y', (s.x + ((s.y + k.c) * (s.y + k.m)) % {p}L) % k.base), s -> s.x * {b}L + s.y)"
    ).replace("{p}", str(PRIME)).replace("{b}", str(b))
    return f"aggregate(sequence(1, {WALKS}), {number}, (x, i) -> if(i > 1 and x < {rows}L, x, {once}))"


def numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(doc_id, size, text_crc32, number) with global row numbers from 0, and the row count."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    placed = scratch.put(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)),
        "rows",
    )
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    # one row per partition
    before = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(before, "part").select("doc_id", "size", "text_crc32", (F.col("before") + F.col("row")).alias("number")), total


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """→ doc_id, size, text_crc32, number, position (shuffled number), shard, slot for every row of ``docs`` (doc_id, text)."""
    rows, total = numbered(docs, Scratch(docs.sparkSession, "shards"))
    moved = rows.withColumn("position", F.expr(permutation("number", max(total, 1), seed)))
    position = F.col("position")
    return moved.select(
        "doc_id", "size", "text_crc32", "number", "position", (position % shards).cast("int").alias("shard"),
        F.expr(f"position div {shards}").alias("slot"),
    )


def permutation_sql(shards: int = SHARDS, seed: int = SEED) -> str:
    """The same shuffle in DuckDB SQL over ``documents``."""
    pair = "x // s.b AS x0, x % s.b AS y0"
    inner = f"SELECT doc_id, text, {pair} FROM walk, s WHERE NOT done"
    for i, (c, m) in enumerate(keys(seed)):
        inner = (
            f"SELECT doc_id, text, y{i} AS x{i + 1}, (x{i} + ((y{i} + {c}) * (y{i} + {m})) % {PRIME}) % s.{'ab'[i % 2]} AS y{i + 1} "
            f"FROM ({inner}) AS r{i}, s"
        )
    size = "strlen(coalesce(text, '')) + 1"
    crc = (
        "list_reduce(list_prepend(4294967295, list_transform(range(strlen(coalesce(text, ''))), "
        "lambda i: (strpos('0123456789ABCDEF', hx[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', hx[2 * i + 2]) - 1)), "
        "lambda c, b: xor(c // 256, crc_table[xor(c % 256, b) + 1]))"
    )
    step = "xor(c // 2, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""
WITH RECURSIVE t AS (
  SELECT list(v ORDER BY n) AS crc_table FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: {step}) AS v FROM (SELECT unnest(range(256)) AS n))
), texts AS (
  SELECT doc_id, text, {size} AS size, hex(encode(coalesce(text, ''))) AS hx FROM documents
), summed AS (
  SELECT doc_id, text, size, xor({crc}, 4294967295) AS text_crc32 FROM texts, t
), s AS (
  SELECT n, a, ((n + a - 1) // a)::BIGINT AS b FROM (SELECT count(*) AS n, greatest(1, ceil(sqrt(count(*))))::BIGINT AS a FROM documents)
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, text_crc32, size) - 1 AS number FROM summed
), walk AS (
  SELECT doc_id, NULL::VARCHAR AS text, number AS x, false AS done FROM numbered
  UNION ALL
  SELECT doc_id, text, x{ROUNDS} * s.b + y{ROUNDS} AS x, x{ROUNDS} * s.b + y{ROUNDS} < s.n AS done FROM ({inner}) AS r, s
)
SELECT n.doc_id, n.size::BIGINT AS size, n.text_crc32::BIGINT AS text_crc32, 'rows' AS law, (w.x % {shards})::INT AS shard,
  (w.x // {shards})::BIGINT AS slot, NULL::INT AS grown_shard
FROM numbered n JOIN walk w USING (doc_id) WHERE w.done"""
