"""feedweir: feed ingestion and article analytics as Spark DataFrame jobs."""

from feedweir.session import build_session, prepare

__all__ = ["build_session", "prepare"]
__version__ = "0.1.0"
