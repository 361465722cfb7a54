"""Intermediate tables in the folder the cluster shares (see sources.shared)."""

from ..sources.shared import drop, folder, partitions, small_batches, sweep, table, tables

__all__ = ["drop", "folder", "partitions", "small_batches", "sweep", "table", "tables"]
