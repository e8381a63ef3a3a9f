"""Data drift, blast radius and incident state as Spark DataFrames."""

from .session import build_session

__all__ = ["build_session"]
