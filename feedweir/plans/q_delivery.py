"""Queries over delivery planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweir import settings as S
from feedweir.operators import delivery as D
from feedweir.plans.oracle_parts import quoted
from feedweir.plans.q_text import IMAGE_SQL
from feedweir.plans.registry import query
from feedweir.plans.views import NOW, now_column

REALTIME = quoted(S.REALTIME_CHANNELS)


@query("active_subscriptions", "SELECT source_id, id, channel FROM v_subscriptions WHERE is_active")
def active_subscriptions(v):
    return D.active_subscriptions(v.subscriptions).select("source_id", "id", "channel")


BATCH = ["source_id", "discovered_at"]
NEWEST = """newest AS (SELECT source_id, discovered_at, article_id FROM (SELECT source_id, discovered_at, id AS article_id,
    row_number() OVER (PARTITION BY source_id, discovered_at ORDER BY published_at DESC, id DESC) AS rn FROM v_articles) x WHERE rn = 1)"""


@query("latest_article_per_batch", f"WITH {NEWEST} SELECT * FROM newest")
def latest_article_per_batch(v):
    return D.latest_article_per_batch(v.articles, BATCH)


WANTED = f"""{NEWEST}, wanted AS (SELECT n.article_id, s.id AS subscription_id, s.channel, translate_enabled, translate_language, n.source_id
    FROM newest n JOIN v_subscriptions s ON s.source_id = n.source_id WHERE s.is_active AND s.channel IN ({REALTIME}))"""


def wanted(v):
    return D.fan_out_deliveries(D.latest_article_per_batch(v.articles, BATCH), v.subscriptions)


@query("fan_out_deliveries", f"WITH {WANTED} SELECT article_id, subscription_id, channel FROM wanted")
def fan_out_deliveries(v):
    return wanted(v).select("article_id", "subscription_id", "channel")


RULES = f"""{WANTED}, rules AS (SELECT w.*, d.id AS delivery_id, CASE WHEN d.status IS NULL THEN 'create' WHEN d.status = 'delivered' THEN 'skip'
    WHEN d.status = 'queued' AND w.channel = 'telegram' THEN 'skip' ELSE 'requeue' END AS action
    FROM wanted w LEFT JOIN v_deliveries d ON d.article_id = w.article_id AND d.subscription_id = w.subscription_id AND d.channel = w.channel)"""


def rules(v):
    return D.requeue_rules(wanted(v), v.deliveries)


@query("requeue_rules", f"WITH {RULES} SELECT article_id, subscription_id, channel, action FROM rules")
def requeue_rules(v):
    return rules(v).select("article_id", "subscription_id", "channel", "action")


BATCHES = f"""{RULES}, batches AS (SELECT channel, article_id, translate_language AS language, CAST(floor(subscription_id / 10000) AS BIGINT) AS part,
    list(subscription_id ORDER BY subscription_id) AS recipients FROM rules WHERE action <> 'skip' AND channel IN ('telegram', 'teams')
    AND translate_enabled AND coalesce(translate_language, '') <> '' GROUP BY ALL)"""


@query("translation_batches", f"WITH {BATCHES} SELECT * FROM batches")
def translation_batches(v):
    return D.translation_batches(rules(v))


@query(
    "missing_translations",
    f"""WITH {BATCHES} SELECT DISTINCT article_id, language FROM batches b WHERE NOT EXISTS (SELECT 1 FROM v_translated t
        WHERE t.article_id = b.article_id AND t.language = b.language)""",
)
def missing_translations(v):
    return D.missing_translations(D.translation_batches(rules(v)), v.translated)


FLAGS = "CASE language " + " ".join(f"WHEN '{k}' THEN '{f}'" for k, f in S.LANGUAGE_FLAGS.items()) + f" ELSE '{S.OTHER_FLAG}' END"


@query(
    "translated_messages",
    f"""WITH {BATCHES}, r AS (SELECT channel, article_id, language, unnest(recipients) AS subscription_id FROM batches)
        SELECT r.subscription_id, r.article_id, r.channel, {FLAGS.replace('CASE language', 'CASE r.language')} || ' ' || t.title AS title,
            t.public_url AS url, coalesce(a.summary, '') AS body, coalesce(t.image_url, a.image_url) AS image_url
        FROM r JOIN v_translated t ON t.article_id = r.article_id AND t.language = r.language JOIN v_articles a ON a.id = r.article_id""",
)
def translated_messages(v):
    return D.translated_messages(D.translation_batches(rules(v)), v.translated, v.articles)


@query(
    "email_digests",
    f"""SELECT subscription_id, CAST(rn AS INT) AS pos, article_id FROM (
        SELECT s.id AS subscription_id, a.id AS article_id, row_number() OVER (PARTITION BY s.id ORDER BY a.published_at DESC, a.id DESC) AS rn
        FROM v_subscriptions s JOIN v_articles a ON a.source_id = s.source_id AND a.created_at >= {NOW} - INTERVAL '7' DAY
        WHERE s.channel = 'email' AND s.is_active AND regexp_matches(s.target, '^[^@ ]+@[^@ ]+\\.[a-z]+$')
          AND NOT EXISTS (SELECT 1 FROM v_deliveries d WHERE d.article_id = a.id AND d.subscription_id = s.id AND d.channel = 'email'
            AND d.status = 'delivered')) x WHERE rn <= 50""",
)
def email_digests(v):
    return D.email_digests(v.subscriptions, v.articles, v.deliveries, now_column())


@query(
    "initial_samples",
    f"""WITH n AS (SELECT source_id, arg_max(id, (published_at, id)) AS article_id FROM v_articles GROUP BY 1)
        SELECT n.article_id, s.id AS subscription_id, s.channel, 'queued' AS status, d.status IS NULL AS is_new
        FROM v_subscriptions s JOIN n ON n.source_id = s.source_id LEFT JOIN v_deliveries d ON d.article_id = n.article_id AND d.subscription_id = s.id
            AND d.channel = s.channel
        WHERE s.channel = 'telegram' AND s.is_active AND s.created_at >= {NOW} - INTERVAL '2' DAY AND d.status IS DISTINCT FROM 'delivered'""",
)
def initial_samples(v):
    created = v.subscriptions.where(F.col("created_at") >= now_column() - F.make_dt_interval(days=F.lit(2)))
    return D.initial_samples(created, v.articles, v.deliveries)


# send results: one per order line, ordered by ship date
RESULTS = """SELECT l_orderkey * 8 + min(l_linenumber) OVER (PARTITION BY l_orderkey) AS delivery_id, l_linenumber AS seq,
    CAST(l_shipdate AS TIMESTAMP) AS tried_at, l_quantity > 30 AS ok, CASE WHEN l_quantity <= 30 THEN 'error ' || CAST(l_linenumber AS STRING) END AS error
    FROM {lineitem}"""


@query(
    "delivery_outcomes",
    f"""WITH results AS ({RESULTS.replace('{lineitem}', 'lineitem')}),
        first_ok AS (SELECT delivery_id, min((tried_at, seq)) AS k FROM results WHERE ok GROUP BY 1),
        t AS (SELECT r.delivery_id, count(*) AS tries, max(tried_at) FILTER (ok) AS d, max(tried_at) FILTER (NOT ok) AS f, arg_max(coalesce(error, ''), (tried_at, seq)) AS e
            FROM results r LEFT JOIN first_ok o ON o.delivery_id = r.delivery_id WHERE o.k IS NULL OR (r.tried_at, r.seq) <= o.k GROUP BY 1)
        SELECT v.id AS delivery_id, subscription_id, CASE WHEN v.status = 'delivered' OR tries IS NULL THEN v.status WHEN d IS NOT NULL THEN 'delivered'
                ELSE 'failed' END AS status,
            CAST(CASE WHEN v.status <> 'delivered' AND tries IS NOT NULL THEN attempts + tries ELSE attempts END AS BIGINT) AS attempts,
            CASE WHEN v.status <> 'delivered' THEN d END AS delivered_at, CASE WHEN v.status <> 'delivered' AND d IS NULL THEN f END AS failed_at,
            CASE WHEN v.status <> 'delivered' AND tries IS NOT NULL AND d IS NULL THEN nullif(e, '') END AS error_message
        FROM v_deliveries v LEFT JOIN t ON t.delivery_id = v.id""",
)
def delivery_outcomes(v):
    results = v.spark.sql(RESULTS.replace("{lineitem}", f"parquet.`{v.dir}/lineitem.parquet`"))
    return D.delivery_outcomes(v.deliveries, results)


def _js(x):
    """JSON text of a sample string: line feeds are the only characters that need escaping."""
    return f"'\"' || replace({x}, chr(10), '\\n') || '\"'"


_MSG = "trim(title || chr(10) || url || CASE WHEN body <> '' THEN chr(10) || chr(10) || body ELSE '' END)"
_HEAD = "'*<' || url || '|' || title || '>*'"
_SECTION = "'{\"type\":\"section\",\"text\":{\"type\":\"mrkdwn\",\"text\":' || "


@query(
    "message_payloads",
    f"""WITH m AS (SELECT d.id AS delivery_id, s.channel, s.target, a.title, coalesce(a.summary, '') AS body, a.canonical_url AS url,
            nullif(a.image_url, '') AS img FROM v_deliveries d JOIN v_articles a ON a.id = d.article_id
            JOIN v_subscriptions s ON s.id = d.subscription_id WHERE s.channel IN ({REALTIME}))
        SELECT delivery_id, channel, CASE channel
            WHEN 'telegram' THEN '{{"chat_id":' || {_js('target')} || CASE WHEN img IS NOT NULL
                THEN ',"photo":' || {_js('img')} || ',"caption":' || {_js(f'left({_MSG}, 1024)')} || '}}'
                ELSE ',"text":' || {_js(_MSG)} || ',"disable_web_page_preview":false}}' END
            WHEN 'slack' THEN '{{"blocks":[' || {_SECTION} {_js(_HEAD)} || '}}}}' || CASE WHEN body <> ''
                THEN ',' || {_SECTION} {_js('left(body, 2000)')} || '}}}}' ELSE '' END || '],"unfurl_links":true}}'
            WHEN 'discord' THEN '{{"embeds":[{{"title":' || {_js('left(title, 256)')} || ',"url":' || {_js('url')} || ',"color":5793266'
                || CASE WHEN body <> '' THEN ',"description":' || {_js('left(body, 2048)')} ELSE '' END || '}}]}}'
            ELSE '{{"type":"message","attachments":[{{"contentType":"application/vnd.microsoft.card.adaptive","content":{{'
                || '"$schema":"http://adaptivecards.io/schemas/adaptive-card.json","type":"AdaptiveCard","version":"1.4","body":['
                || '{{"type":"TextBlock","size":"Medium","weight":"Bolder","text":' || {_js('left(title, 256)')} || '}}'
                || CASE WHEN img IS NOT NULL THEN ',{{"type":"Image","size":"Stretch","url":' || {_js('img')} || ',"altText":' || {_js('left(title, 256)')} || '}}'
                    ELSE '' END
                || CASE WHEN body <> '' THEN ',{{"type":"TextBlock","text":' || {_js('left(body, 2000)')} || ',"wrap":true}}' ELSE '' END
                || '],"actions":[{{"type":"Action.OpenUrl","title":"Read Article","url":' || {_js('url')} || '}}]}}}}]}}' END AS payload_json FROM m""",
)
def message_payloads(v):
    return D.message_payloads(v.deliveries, v.articles, v.subscriptions)


@query(
    "delivery_image_choice",
    f"""WITH m AS (SELECT d.id AS delivery_id, d.article_id, s.translate_language AS language, 'https://cdn.example.org/m/' || d.id || '.png' AS image_url
            FROM v_deliveries d JOIN v_subscriptions s ON s.id = d.subscription_id WHERE d.channel = 'teams'),
        j AS (SELECT m.delivery_id, coalesce(t.image_url, a.image_url, m.image_url) AS url FROM m LEFT JOIN v_translated t ON t.article_id = m.article_id
            AND t.language = m.language LEFT JOIN v_articles a ON a.id = m.article_id)
        SELECT delivery_id, CASE WHEN url = '' OR coalesce({IMAGE_SQL}, false) THEN url END AS image_url FROM j""",
)
def delivery_image_choice(v):
    languages = v.subscriptions.select(F.col("id").alias("subscription_id"), F.col("translate_language").alias("language"))
    messages = v.deliveries.where("channel = 'teams'").join(languages, "subscription_id").select(
        F.col("id").alias("delivery_id"), "article_id", "language",
        F.concat(F.lit("https://cdn.example.org/m/"), F.col("id").cast("string"), F.lit(".png")).alias("image_url"),
    )
    return D.delivery_image_choice(messages, v.articles, v.translated)
