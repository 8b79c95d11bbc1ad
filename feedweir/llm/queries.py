"""The operators bound to the sample tables: ``op<N>_<name>`` over whole tables, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweir.llm import divergence, mixing, near, packing, phrases, quality, search, sharding, spelling, toxicity, url_rules, viterbi, winnowing
from feedweir.llm.scratch import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Target shares of tokens by domain of ``labels``.
TARGETS = {"clean": 0.90, "toxic": 0.02, "poor": 0.08}
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
BYTE_BPE = "byte_bpe_50k.json"
UNIGRAM = "piece_bpe_32k.model"


def _query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` as a table of domains: poor, toxic or clean."""
    kind = F.when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    return table(spark, sf_dir, "labels").select("doc_id", kind.alias("domain"))


@_query
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates at which documents are drawn so that clean, toxic and poor text meet their target shares of tokens."""
    out, names, _ = mixing.rated(table(spark, sf_dir, "documents").select("doc_id", "text"), domains(spark, sf_dir), TARGETS)
    posteriors = [F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(names)]
    return out.select("doc_id", "tokens", *posteriors, "rate", "copies")


@_query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the longest fitting rule on every page's URL."""
    return url_rules.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule string, verdict string"))


_RULES_SQL = ", ".join(f"('{r}', '{v}', '{r[: r.find('/')]}', '{r[r.find('/') :]}')" for r, v in RULES)
ORACLES["op2_url_filter"] = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), halves AS (
  SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM cut
), rules(rule, verdict, rule_host, rule_path) AS (VALUES {_RULES_SQL}
), fitting AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM halves, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, '{url_rules.DEFAULT}') AS verdict
FROM halves h LEFT JOIN fitting f USING (page_id)"""


@_query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by 50-word windows that also begin in an earlier document go."""
    cut = phrases.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query
def op4_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 100."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.top_k(docs, docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"))


ORACLES["op4_bm25_search"] = rf"""
WITH words AS (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^0-9a-z_\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '')) AS term
  FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), sizes AS (SELECT doc_id, sum(tf) AS size FROM tf GROUP BY doc_id
), totals AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(size) FROM sizes) / (SELECT count(*) FROM documents) AS mean_size
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), scores AS (
  SELECT q.doc_id AS query_id, d.doc_id,
    round(sum(q.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * d.tf * {search.K1 + 1}
      / (d.tf + {search.K1} * (1 - {search.B} + {search.B} * size / mean_size))), {search.DIGITS}) AS score
  FROM tf q JOIN tf d USING (term) JOIN df USING (term) JOIN sizes s ON s.doc_id = d.doc_id, totals
  WHERE q.doc_id % 100 = 0 GROUP BY ALL
)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
FROM scores QUALIFY rank <= {search.K}"""


@_query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of every document and of its edited text, and how alike they are."""
    both = winnowing.edited(table(spark, sf_dir, "documents"))
    return both.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        winnowing.as_text("chosen").alias("fingerprint"), winnowing.as_text("edited_chosen").alias("edited_fingerprint"), "near_edited", "near_next",
    )


@_query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    return viterbi.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(UNIGRAM))


@_query
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: five-word shingles, similarity of 0.8 and more."""
    return near.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 2,048 tokens, each of them in the corpus's own mixture of sources."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", F.col("queue").alias("source")
    )


@_query
def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal row counts in a reproducible random order."""
    rows = sharding.shard(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


ORACLES["op9_feistel_shards"] = sharding.permutation_sql()


@_query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the word use of every source is from the others of its language, and its ten most distinctive terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op11_source_divergence"] = divergence.audit_sql()


@_query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with the number of words one edit away, its more frequent form and the root of its forms."""
    return spelling.variants(table(spark, sf_dir, "documents"))


ORACLES["op12_spelling_variants"] = spelling.variants_sql()


@_query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
