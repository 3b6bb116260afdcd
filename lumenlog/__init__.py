"""Log and incident analytics expressed as Spark DataFrame and streaming jobs."""

from lumenlog.session import get_session

__all__ = ["get_session"]
