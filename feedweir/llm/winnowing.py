"""Document fingerprints by winnowing, in column expressions.

The words of a text (runs of non-space) give rolling hashes of ``GRAM`` consecutive words. Of every ``WIDTH`` consecutive hashes
the smallest is chosen, of equal ones the rightmost; the chosen hashes with their positions are the fingerprint. Two
texts that share ``GRAM + WIDTH - 1`` consecutive words share a hash, and nothing shorter than ``GRAM`` words ever does.

A hash and its position are one long (33 bits of hash, 30 bits of reversed position), so a minimum is the rightmost smallest
hash; minima over 2, 4, 8 hashes are made by doubling.

Neighbours in id order are found without a global sort in one task: ranges of ids, one window per range, and the first
document of a range is also sent to the range that needs it as the next.

Edge cases: null and empty texts have an empty fingerprint; texts of fewer than ``GRAM`` words are one hash; two empty fingerprints are
alike (1), an empty and another are not (0); a null id counts as the smallest; equal ids are ordered by a hash of their text; a
single document is its own next; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

GRAM = 5
WIDTH = 8
POSITION_BITS = 30
#: Documents in one range of neighbours.
RANGE_ROWS = 2000
_LOW = (1 << POSITION_BITS) - 1
_LOWEST = -(1 << 63)


def fingerprinted(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the chosen (hash, position) longs of the column ``text`` (not null)."""
    size = f"size(_{out}_h)"
    gram = ", ".join(f"_{out}_h[i + {j}]" for j in range(GRAM))
    packed = f"(shiftrightunsigned({{}}, 31) * {1 << POSITION_BITS}L + {_LOW}L - i)"
    keys = f"""CASE WHEN {size} >= {GRAM} THEN transform(sequence(0, {size} - {GRAM}), i -> {packed.format(f"xxhash64({gram})")})
        WHEN {size} > 0 THEN transform(array(0), i -> {packed.format(f"xxhash64(_{out}_h)")}) ELSE array() END"""
    kept = df.columns
    df = df.select(*kept, F.expr(rf"transform(array_remove(split({text}, '[\\x09-\\x0D ]+'), ''), x -> xxhash64(x))").alias(f"_{out}_h"))
    df = df.select(*kept, F.expr(keys).alias(f"_{out}_1"))
    reach = 1
    while reach < WIDTH:
        name = f"_{out}_{reach}"
        df = df.select(
            *kept, F.expr(f"size({name})").alias("_n") if reach == 1 else F.col("_n"),
            F.expr(f"transform({name}, (x, i) -> least(x, get({name}, i + {reach})))").alias(f"_{out}_{reach * 2}"),
        )
        reach *= 2
    # windows that reach beyond the end are no windows, but a text shorter than one is a window of its own
    chosen = f"array_distinct(slice(_{out}_{WIDTH}, 1, greatest(1, _n - {WIDTH - 1})))"
    return df.select(*kept, F.expr(chosen).alias(out))


def hashes(chosen: str) -> Column:
    return F.expr(f"array_distinct(transform({chosen}, x -> shiftright(x, {POSITION_BITS})))")


def as_text(chosen: str) -> Column:
    """``hash@position`` of each chosen hash."""
    one = f"concat(hex(shiftright(x, {POSITION_BITS})), '@', string({_LOW}L - (x & {_LOW}L)))"
    return F.expr(f"concat_ws(' ', transform({chosen}, x -> {one}))")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two hash sets, 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def ranges(ids: DataFrame, rows: int = RANGE_ROWS) -> tuple[list[int], list[int]]:
    """Smallest and largest id of ranges of about ``rows`` rows: two longs per range reach the driver."""
    parts = max(1, -(-ids.count() // rows))
    found = (
        ids.repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("part"))
        .agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("low").collect()
    )
    return [r["low"] for r in found], [r["high"] for r in found]


def _range_of(lows: list[int]) -> str:
    """SQL of the range of ``key`` by binary search."""
    steps = max(1, (len(lows)).bit_length())
    array = f"array({', '.join(f'{x}L' if x > _LOWEST else f'({x + 1}L - 1L)' for x in lows)})"
    jumps = f"array({', '.join(str(1 << s) for s in reversed(range(steps)))})"
    return f"aggregate({jumps}, 0, (at, jump) -> if(get({array}, at + jump) <= key, at + jump, at))"


def with_next(docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text, chosen, next_text, next_chosen: every document beside the next one in descending id order."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    lows, highs = ranges(texts.select("key"), rows)
    if not lows:
        lows, highs = [0], [0]
    at = texts.withColumn("range", F.expr(_range_of(lows)))
    high = F.get(F.array(*[F.lit(x) for x in highs]), F.col("range"))
    after = (F.col("range") + 1) % len(lows)
    sent = at.select(
        "doc_id", "text", "key", F.posexplode(F.when(F.col("key") == high, F.array("range", after)).otherwise(F.array("range"))).alias("guest", "to")
    )
    marked = fingerprinted(sent.repartition("to"), "text", "chosen")
    order = W.partitionBy("to").orderBy("guest", F.desc("key"), F.xxhash64("text"))
    beside = marked.select("*", F.lead("text").over(order).alias("next_text"), F.lead("chosen").over(order).alias("next_chosen"))
    return beside.where("guest = 0").select("doc_id", "text", "chosen", "next_text", "next_chosen")


def edited(docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """Every document with its last third replaced by the beginning of the next one, and the fingerprints of both.

    → doc_id, text, chosen, edited, edited_chosen, near_edited, near_next.
    """
    cut = "char_length(text) div 3"
    pairs = with_next(docs, rows).withColumn("edited", F.expr(f"concat(left(text, char_length(text) - {cut}), left(next_text, {cut}))"))
    both = fingerprinted(pairs.drop("next_text"), "edited", "edited_chosen")
    sets = both.select("*", hashes("chosen").alias("_a"), hashes("edited_chosen").alias("_b"), hashes("next_chosen").alias("_c"))
    return sets.select(
        "doc_id", "text", "chosen", "edited", "edited_chosen", likeness("_a", "_b").alias("near_edited"), likeness("_a", "_c").alias("near_next")
    )
