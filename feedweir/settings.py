"""Fixed values of the ingestion domain.

Thresholds, word lists and patterns below must equal the published ones for results to match; they are
fixed values, stated as they are.
"""

from __future__ import annotations

# --- URL canonicalisation (fixed values) -------------------------------------------------------------
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = [
    "fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "ysclid", "_ga", "_gl",
]

# --- text limits (fixed values) ----------------------------------------------------------------------
TITLE_LIMIT = 240
SUMMARY_LIMIT = 420
JSON_TITLE_LIMIT = 120
DEFAULT_TITLE = "Untitled article"
PREVIEW_DEFAULT_TITLE = "Untitled"
JSON_DEFAULT_TITLE = "Untitled item"
SLUG_LIMIT = 80
ERROR_MESSAGE_BYTES = 4000
SNAPSHOT_BYTES = 250_000
SNAPSHOT_BYTES_FLOOR = 4096

# --- blocked copy (fixed values) ---------------------------------------------------------------------
FEED_TITLE_BLOCKED = [
    "read more", "learn more", "subscribe", "sign up", "log in", "menu", "search", "back to", "home",
]
FEED_SUMMARY_BLOCKED = ["subscribe", "privacy", "cookie", "sign up", "log in"]
LISTING_COPY_BLOCKED = [
    "read more", "learn more", "subscribe", "sign up", "privacy", "terms", "cookie", "back to", "search",
    "menu", "log in",
]
LISTING_IMAGE_BLOCKED = [
    "avatar", "profile", "author", "user", "logo", "icon", "emoji", "favicon", "gravatar", "sprite", "badge",
    "placeholder",
]
PAGE_IMAGE_BLOCKED = [
    "avatar", "profile", "author", "user", "emoji", "favicon", "gravatar", "sprite", "placeholder",
]
HREF_PREFIX_BLOCKED = ["#", "javascript:", "mailto:", "tel:"]
HREF_EXTENSIONS_BLOCKED = ["jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "pdf", "xml"]
HREF_PATHS_BLOCKED = [
    "/tag/", "/tags/", "/category/", "/categories/", "/author/", "/about", "/privacy", "/terms", "/contact",
    "/login", "/signup",
]
TITLE_MIN, TITLE_MAX = 12, 220
SUMMARY_MIN = 24
LISTING_SUMMARY_MIN = 40

# --- article candidate score (fixed values) ----------------------------------------------------------
CANDIDATE_PATHS_BLOCKED = [
    "rss", "feed", "feeds", "news", "latest", "video", "videos", "search", "tag", "tags", "topic", "topics",
    "category", "categories", "about", "contact", "privacy", "terms", "login", "signup", "register",
    "podcast", "podcasts",
]
CANDIDATE_EXTENSIONS_BLOCKED = ["jpg", "jpeg", "png", "gif", "svg", "webp", "pdf", "xml"]
CANDIDATE_MIN_SCORE = 2

# --- listing patterns (fixed values) -----------------------------------------------------------------
SIGNATURE_CLASSES_BLOCKED = [
    "active", "item", "items", "card", "cards", "content", "inner", "wrapper", "grid", "list", "row", "col",
    "container",
]
SIGNATURE_CLASS_PREFIXES = r"^(js-|is-|has-|u-|mt-|pt-|mb-|pb-|d-|col-|row$)"
CARD_TAGS = ["article", "li", "div", "section"]
PATTERN_MIN_ITEMS = 3
PATTERN_MIN_CONFIDENCE = 0.62

# --- discovery (fixed values) ------------------------------------------------------------------------
TYPE_WEIGHTS = {"rss": 6, "atom": 5, "json_feed": 4, "html_autodiscovery": 3, "html": 2}
TYPE_WEIGHT_OTHER = 1
HTML_SCHEMA_BONUS = 5500
FEED_TYPES = ["rss", "atom", "json_feed"]
FEED_LABEL_SIGNALS = ["rss", "atom", "feed", "subscribe via rss", "subscribe", "xml"]
FEED_HREF_SIGNALS = ["/rss", "rss.", "/feed", "feed/", "atom", ".xml", "/xml"]
AUTODISCOVERY_TYPES = {
    "application/rss+xml": "rss",
    "application/rdf+xml": "rss",
    "application/atom+xml": "atom",
    "application/feed+json": "json_feed",
    "application/json": "json_feed",
}
PROBE_PATHS = [
    "/rss", "/rss.xml", "/feed", "/feed.xml", "/atom.xml", "/index.xml", "/news/rss.xml", "/rss/news.xml",
    "/rss/full.rss",
]
PROBE_HOSTS = {
    "tsn.ua": "https://tsn.ua/rss/full.rss",
    "bbc.com": "https://feeds.bbci.co.uk/news/rss.xml",
    "bbc.co.uk": "https://feeds.bbci.co.uk/news/rss.xml",
    "npr.org": "https://feeds.npr.org/1001/rss.xml",
    "cnbc.com": "https://www.cnbc.com/id/100003114/device/rss/rss.html",
    "dw.com": "https://rss.dw.com/xml/rss-en-top",
    "axios.com": "https://api.axios.com/feed",
}
PROBE_MAX = 6
PARSE_MAX_ITEMS = 100
LINK_CANDIDATES_MAX = 50

# --- page metadata (fixed values) --------------------------------------------------------------------
TITLE_SUFFIX_LABELS = [
    "GitHub Blog", "GitHub Changelog", "Microsoft Azure Blog", "Microsoft SQL Server Blog",
    "Amazon Web Services",
]
GENERIC_TITLES = ["home", "homepage", "news |", "blog |", "updates |", "microsoft azure", "azure updates"]
GENERIC_DESCRIPTIONS = [
    "subscribe to microsoft azure today for service updates", "check out the new cloud platform roadmap",
    "the latest news from", "learn more about", "read more about",
]
PAGE_TITLE_MIN = 12
PAGE_DESCRIPTION_MIN = 20
PAGE_PARAGRAPH_MIN = 80

# --- article bodies (fixed values) -------------------------------------------------------------------
NOISE_TAGS = ["nav", "header", "footer", "aside"]
NOISE_CLASSES = [
    "nav", "footer", "header", "sidebar", "cookie", "popup", "modal", "share", "social", "comments", "related",
]
NOISE_IDS = ["comments"]
NOISE_ROLES = ["navigation", "banner", "complementary"]
BODY_CLASSES = [
    "post-content", "blog-post-content", "article-body", "article-content", "entry-content", "post-body",
    "rich-content", "post__content",
]
BODY_HOOKS = ["post-body", "post-content"]
BODY_MIN_BYTES = 200

# --- polling, health, registry (fixed values) --------------------------------------------------------
ACTIVE_INTERVAL_MIN = 5
IDLE_INTERVAL_MIN = 60
COLD_INTERVAL = 10_080
INACTIVE_INTERVAL = 1_440
COLD_AFTER_DAYS = 30
JITTER_SECONDS = 120
MAX_PER_DOMAIN = 2
MAX_PER_CYCLE = 180
DOMAIN_FETCHES_PER_MINUTE = 12
REPAIR_FAILURES = 3
REPAIR_COOLDOWN_MINUTES = 60
HEALTH_START, HEALTH_FLOOR, HEALTH_GAIN, HEALTH_MAX = 50, 40, 8, 100
HEALTH_SOFT_DROP, HEALTH_HARD_DROP = 10, 15
HEALTH_SOFT_ERRORS = ["timeout", "network", "http_5xx"]
STALE_GENERATIONS_MAX = 200
GENERATION_TIMEOUT_SECONDS = 180
GENERATION_TIMEOUT_FLOOR = 30
PENDING_STATUSES = ["queued", "discovering", "fetching", "parsing"]
SHADOW_RUNS = 2
ACTIVATE_SCORE = 70
VALIDATION_MIN_ITEMS = 3
VALIDATION_SNAPSHOTS = 3
REVALIDATE_HOURS = 12
REVALIDATE_MAX = 50
PREVIEW_MIN_ITEMS = 4
PREVIEW_ITEMS = 12
FRESH_MINUTES = 60
IMAGE_LOOKUPS = 12
ENRICH_BATCH = 20
HTML_STRATEGIES = ["deterministic_html_schema", "ai_xpath_schema"]
STRATEGIES = {"rss": "deterministic_rss", "atom": "deterministic_atom", "json_feed": "deterministic_json_feed"}
STRATEGY_OTHER = "deterministic_feed"

# --- delivery (fixed values) -------------------------------------------------------------------------
REALTIME_CHANNELS = ["telegram", "slack", "discord", "teams"]
TRANSLATABLE_CHANNELS = ["telegram", "teams"]
DIGEST_DAYS, DIGEST_ITEMS = 7, 50
CAPTION_LIMIT, BODY_LIMIT, EMBED_LIMIT, HEADING_LIMIT = 1024, 2000, 2048, 256
EMBED_COLOR = 0x5865F2
LANGUAGE_FLAGS = {
    "uk": "🇺🇦", "en": "🇬🇧", "es": "🇪🇸", "fr": "🇫🇷", "de": "🇩🇪", "it": "🇮🇹", "pt": "🇵🇹", "ja": "🇯🇵",
    "ko": "🇰🇷", "zh": "🇨🇳", "ar": "🇸🇦", "ru": "🇷🇺", "pl": "🇵🇱", "nl": "🇳🇱", "tr": "🇹🇷",
}
OTHER_FLAG = "🌐"
