"""Cells of table collections: building, cleaning, padding, transposing, sampling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def to_cells(tables: DataFrame, table_id: str = "table_id", data: str = "data") -> DataFrame:
    """`cells` of rows that hold a whole table as array<array<string>>; ragged rows give ragged cells, nulls ''."""
    rows = tables.select(F.col(table_id).cast("string").alias("table_id"), F.posexplode(data).alias("row_idx", "row"))
    return rows.select("table_id", "row_idx", F.posexplode("row").alias("col_idx", "value")).withColumn("value", F.coalesce("value", F.lit("")))


def to_rows(cells: DataFrame) -> DataFrame:
    """(table_id, data): back to one array<array<string>> for each table, in order."""
    row = cells.groupBy("table_id", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "value"))).alias("r"))
    return row.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", F.col("r.value").alias("v")))).alias("t")).select("table_id", F.col("t.v").alias("data"))


@F.pandas_udf(StringType())
def repair_text(values: pd.Series) -> pd.Series:
    """Undo escape sequences and UTF-8 read as Latin-1 (the one step that no Spark expression covers)."""

    def fix(v):
        if v is None:
            return ""
        try:
            out = v.encode("latin-1").decode("unicode-escape") if "\\" in v else v
        except (UnicodeEncodeError, UnicodeDecodeError):
            out = v
        try:
            return out.encode("latin-1").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return out

    return values.map(fix)


def repair(cells: DataFrame) -> DataFrame:
    """Mojibake repair; only values past plain ASCII or with a backslash go to Python."""
    odd = F.col("value").rlike(r"[^\x00-\x5b\x5d-\x7f]")
    some = cells.where(odd).withColumn("value", repair_text("value"))
    return cells.where(~odd).unionByName(some)


def drop_blank_rows(cells: DataFrame) -> DataFrame:
    """Rows whose cells are all empty or spaces go; the rest are numbered anew."""
    full = cells.groupBy("table_id", "row_idx").agg(F.max((F.trim("value") != "").cast("int")).alias("f")).where("f = 1")
    new = full.select("table_id", "row_idx", (F.row_number().over(Window.partitionBy("table_id").orderBy("row_idx")) - 1).alias("new"))
    return cells.join(new, ["table_id", "row_idx"]).select("table_id", F.col("new").alias("row_idx"), "col_idx", "value")


def pad(cells: DataFrame) -> DataFrame:
    """Short rows get '' up to the widest row of their table."""
    width = cells.groupBy("table_id").agg(F.max("col_idx").alias("w"))
    # one row a table on the right, so the join never multiplies
    row = cells.groupBy("table_id", "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("col_idx", "value"))).alias("m")).join(width, "table_id")
    return row.select("table_id", "row_idx", F.explode(F.sequence(F.lit(0), "w")).alias("col_idx"), "m").select("table_id", "row_idx", "col_idx", F.coalesce(F.try_element_at("m", "col_idx"), F.lit("")).alias("value"))


def drop_empty_columns(cells: DataFrame) -> DataFrame:
    """Columns whose cells are all exactly '' go; the rest are numbered anew."""
    full = cells.groupBy("table_id", "col_idx").agg(F.max((F.col("value") != "").cast("int")).alias("f")).where("f = 1")
    new = full.select("table_id", "col_idx", (F.row_number().over(Window.partitionBy("table_id").orderBy("col_idx")) - 1).alias("new"))
    return cells.join(new, ["table_id", "col_idx"]).select("table_id", "row_idx", F.col("new").alias("col_idx"), "value")


def clean(cells: DataFrame) -> DataFrame:
    return drop_empty_columns(pad(drop_blank_rows(repair(cells))))


def transpose(cells: DataFrame, when: Column | None = None) -> DataFrame:
    """Swap rows and columns (of the tables for which `when` holds)."""
    swap = F.lit(True) if when is None else when
    return cells.withColumns({"row_idx": F.when(swap, F.col("col_idx")).otherwise(F.col("row_idx")), "col_idx": F.when(swap, F.col("row_idx")).otherwise(F.col("col_idx"))})


def sample(cells: DataFrame, most: int = 400, head: int = 10, seed: int = 0) -> DataFrame:
    """Tables of more than `most` rows keep their first `head` and others by hash order, `most` in all, renumbered."""
    rows = cells.select("table_id", "row_idx").distinct()
    key = F.md5(F.concat_ws(":", "table_id", "row_idx", F.lit(seed)))
    by_table = Window.partitionBy("table_id")
    ranked = rows.select("*", F.count("*").over(by_table).alias("n"), F.row_number().over(by_table.orderBy((F.col("row_idx") >= head).cast("int"), F.when(F.col("row_idx") >= head, key), "row_idx")).alias("k"))
    kept = ranked.where((F.col("n") <= most) | (F.col("k") <= most))
    new = kept.select("table_id", "row_idx", (F.row_number().over(by_table.orderBy("row_idx")) - 1).alias("new"))
    return cells.join(new, ["table_id", "row_idx"]).select("table_id", F.col("new").alias("row_idx"), "col_idx", "value")


def shape(cells: DataFrame) -> DataFrame:
    return cells.groupBy("table_id").agg((F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols"))
