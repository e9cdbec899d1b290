"""clausegrid: regulatory-text analytics as PySpark DataFrame jobs."""

from clausegrid.session import build_session

__all__ = ["build_session"]
