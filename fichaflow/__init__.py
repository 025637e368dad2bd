"""Machine telemetry and coin-sales analytics on Spark DataFrames."""

from fichaflow.session import build_session

__all__ = ["build_session"]
