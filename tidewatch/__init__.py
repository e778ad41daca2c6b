"""Exposure analytics on Spark: detection, scoring and ledger workflow as DataFrames."""

from tidewatch.session import prepare

__all__ = ["prepare"]
