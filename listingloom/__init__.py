"""Business-listing enrichment and batch analytics as Spark DataFrame jobs."""

from listingloom.session import build_session, prepare_session

__all__ = ["build_session", "prepare_session"]
