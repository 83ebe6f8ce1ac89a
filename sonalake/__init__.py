"""Spark-first analytics for populations of recorded signals."""

from .session import get_session

__all__ = ["get_session"]
