"""Named queries: operators bound to the entity views, each with its oracle where SQL can express it."""

import importlib

from feedweir.plans.registry import ORACLES, QUERIES, bound

MODULES = ["q_catalog", "q_text", "q_articles", "q_crawl", "q_polling", "q_schemas", "q_delivery", "q_reports", "q_feeds", "q_pages", "q_streaming"]

for _name in MODULES:
    importlib.import_module(f"feedweir.plans.{_name}")


def all_queries() -> list[str]:
    return list(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)


__all__ = ["all_queries", "bound", "oracles"]
