"""Sinks: the label index, the graph and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_index(index: DataFrame, path: str, buckets: int = 64) -> None:
    """The label index by entity bucket; an index that is there already stays as it is."""
    index.withColumn("bucket", F.pmod(F.xxhash64("entity"), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("bucket", "length").write.mode("ignore").partitionBy("bucket").parquet(path)


def write_graph(edges: DataFrame, path: str, buckets: int = 256) -> None:
    """Edges by subject bucket, so that point reads and joins on subjects prune; an existing graph stays as it is."""
    edges.withColumn("bucket", F.pmod(F.xxhash64("subject"), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("bucket", "subject").write.mode("ignore").partitionBy("bucket").parquet(path)


def point_read(graph: DataFrame, entities: list[str], buckets: int = 256) -> DataFrame:
    """Edges of a few entities out of a table written by `write_graph`, with partition pruning."""
    named = graph.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, entities))).alias("e"))
    wanted = [r[0] for r in named.select(F.pmod(F.xxhash64("e"), F.lit(buckets)).cast("int")).distinct().collect()]
    return graph.where(F.col("bucket").isin(wanted) & F.col("subject").isin(entities))


def table_json(result: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, json): all rows of a table as one JSON array."""
    rest = [c for c in result.columns if c != key]
    return result.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("json"))
