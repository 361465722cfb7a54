"""Tables to annotate, a label index and a knowledge graph as views over the star schema, with their SQL twins.

Entities are letters and keys (R1, N3, S7, C9, P2, O5), types T:<name>. Tables hold 20 suppliers or customers with a
header row; of every fifth row the name misses a letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART_OF, LOCATED, PLACED, CONTAINS, SHIPPED = "P361", "P131", "P8001", "P8002", "P8003"
KIND, IS_A, SUBCLASS, DATE, PRICE, SEGMENT, BRAND = "P106", "P31", "P279", "P585", "P2284", "P452", "P1716"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def named(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def noisy(name: Column, key: Column) -> Column:
    at = F.pmod(key, F.length(name)).cast("int")
    cut = F.concat(F.substring(name, F.lit(1), at), name.substr(at + 2, F.length(name)))
    return F.when(key % 5 == 0, cut).otherwise(name)


def money(c: Column) -> Column:
    """A decimal text that both engines write alike."""
    cents = F.round(c * 100).cast("bigint")
    a = F.abs(cents)
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.floor(a / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((a % 100).cast("string"), 2, "0"))


def _grid(df: DataFrame, prefix: str, key: str, head: list[str], values: list[Column]) -> DataFrame:
    tid = F.concat(F.lit(prefix), F.floor(F.col(key) / 20).cast("string"))
    body = df.select(tid.alias("table_id"), (F.col(key) % 20 + 1).cast("int").alias("row_idx"), F.posexplode(F.array(*values)).alias("col_idx", "value"))
    top = df.select(tid.alias("table_id")).distinct().select("table_id", F.lit(0).alias("row_idx"), F.posexplode(F.array(*map(F.lit, head))).alias("col_idx", "value"))
    return top.unionByName(body)


def supplier_cells(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (read(spark, sf, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return _grid(j, "S", "s_suppkey", ["name", "nation", "region", "balance"], [noisy(F.col("s_name"), F.col("s_suppkey")), F.col("n_name"), F.col("r_name"), money(F.col("s_acctbal"))])


def customer_cells(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (read(spark, sf, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return _grid(j, "C", "c_custkey", ["name", "nation", "region", "segment", "balance"], [noisy(F.col("c_name"), F.col("c_custkey")), F.col("n_name"), F.col("r_name"), F.col("c_mktsegment"), money(F.col("c_acctbal"))])


_NOISE = "CASE WHEN {k} % 5 = 0 THEN substr({n}, 1, CAST({k} % length({n}) AS INT)) || substr({n}, CAST({k} % length({n}) AS INT) + 2) ELSE {n} END"
_MONEY = "CASE WHEN round({c} * 100) < 0 THEN '-' ELSE '' END || CAST(abs(CAST(round({c} * 100) AS BIGINT)) // 100 AS VARCHAR) || '.' || lpad(CAST(abs(CAST(round({c} * 100) AS BIGINT)) % 100 AS VARCHAR), 2, '0')"


def _grid_sql(name: str, source: str, prefix: str, key: str, head: list[str], values: list[str]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{prefix}' || CAST({key} // 20 AS VARCHAR) AS table_id, CAST({key} % 20 + 1 AS INT) AS row_idx, {i} AS col_idx, {v} AS value FROM {source}" for i, v in enumerate(values))
    tops = " UNION ALL ".join(f"SELECT DISTINCT '{prefix}' || CAST({key} // 20 AS VARCHAR), 0, {i}, '{h}' FROM {source}" for i, h in enumerate(head))
    return f"{name} AS ({tops} UNION ALL {rows})"


S_CELLS = _grid_sql("cells", "supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "S", "s_suppkey", ["name", "nation", "region", "balance"], [_NOISE.format(k="s_suppkey", n="s_name"), "n_name", "r_name", _MONEY.format(c="s_acctbal")]).replace("cells AS (", "cells(table_id, row_idx, col_idx, value) AS (", 1)
C_CELLS = _grid_sql("cells", "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "C", "c_custkey", ["name", "nation", "region", "segment", "balance"], [_NOISE.format(k="c_custkey", n="c_name"), "n_name", "r_name", "c_mktsegment", _MONEY.format(c="c_acctbal")]).replace("cells AS (", "cells(table_id, row_idx, col_idx, value) AS (", 1)


def label_dump(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of regions, nations and suppliers; page rank is the number of direct members."""
    s, n, r = (read(spark, sf, t) for t in ("supplier", "nation", "region"))
    rank_n = s.groupBy("s_nationkey").agg(F.count("*").alias("pr"))
    rank_r = n.groupBy("n_regionkey").agg(F.count("*").alias("pr"))
    parts = [
        r.join(rank_r, r["r_regionkey"] == rank_r["n_regionkey"], "left").select(named("R", "r_regionkey").alias("ID"), F.coalesce("pr", F.lit(0)).cast("double").alias("page_rank"), F.col("r_name").alias("label")),
        n.join(rank_n, n["n_nationkey"] == rank_n["s_nationkey"], "left").select(named("N", "n_nationkey").alias("ID"), F.coalesce("pr", F.lit(0)).cast("double").alias("page_rank"), F.col("n_name").alias("label")),
        s.select(named("S", "s_suppkey").alias("ID"), F.lit(0.0).alias("page_rank"), F.col("s_name").alias("label")),
    ]
    all_ = parts[0].unionByName(parts[1]).unionByName(parts[2])
    bare = F.regexp_replace("label", "[^0-9A-Za-z]+", " ")
    return all_.select("ID", "page_rank", F.array("label").alias("labels"), F.array(bare).alias("main_aliases"), F.array(F.element_at(F.split(bare, " "), -1), bare).alias("sub_aliases"))


INDEX_SQL = """
dump AS (
  SELECT 'R' || r_regionkey AS entity, CAST((SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS DOUBLE) AS pr, r_name AS label FROM region
  UNION ALL SELECT 'N' || n_nationkey, CAST((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS DOUBLE), n_name FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 0.0, s_name FROM supplier
), bare AS (SELECT *, regexp_replace(label, '[^0-9A-Za-z]+', ' ', 'g') AS main FROM dump),
index_ AS (
  SELECT entity, pr, label, 'LABEL' AS origin FROM bare
  UNION ALL SELECT entity, pr, main, 'MAIN_ALIAS' FROM bare WHERE main <> label
  UNION ALL SELECT entity, pr, split_part(main, ' ', -1), 'SUB_ALIAS' FROM bare WHERE split_part(main, ' ', -1) NOT IN (main, label)
)"""


def edges(spark: SparkSession, sf: str, orders: bool = True) -> DataFrame:
    """The graph, forward and mirrored; without `orders` only of regions, nations, suppliers, customers and parts."""
    from ..operators.graph import mirrored

    r, n, c, s, p = (read(spark, sf, t) for t in ("region", "nation", "customer", "supplier", "part"))

    def e(df, subject, pid, obj, tag="NORMAL"):
        return df.select(subject.alias("subject"), F.lit(pid).alias("pid"), F.lit(False).alias("backward"), obj.cast("string").alias("object"), F.lit(tag).alias("tag"), F.lit(0).alias("ord"))

    out = [
        e(n, named("N", "n_nationkey"), PART_OF, named("R", "n_regionkey")), e(c, named("C", "c_custkey"), LOCATED, named("N", "c_nationkey")), e(s, named("S", "s_suppkey"), LOCATED, named("N", "s_nationkey")),
        e(r, named("R", "r_regionkey"), IS_A, F.lit("T:region")), e(n, named("N", "n_nationkey"), IS_A, F.lit("T:nation")), e(c, named("C", "c_custkey"), IS_A, F.lit("T:customer")), e(s, named("S", "s_suppkey"), IS_A, F.lit("T:supplier")),
        e(p, named("P", "p_partkey"), IS_A, F.lit("T:part")), e(p, named("P", "p_partkey"), KIND, F.concat(F.lit("T:"), "p_type")),
        e(c, named("C", "c_custkey"), SEGMENT, F.col("c_mktsegment"), "String"), e(p, named("P", "p_partkey"), BRAND, F.col("p_brand"), "String"),
        e(c, named("C", "c_custkey"), PRICE, money(F.col("c_acctbal")), "Quantity-dollar"), e(s, named("S", "s_suppkey"), PRICE, money(F.col("s_acctbal")), "Quantity-dollar"),
    ]
    up = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in TREE])).alias("x")).select("x.*")
    out.append(e(up, F.col("a"), SUBCLASS, F.col("b")))
    if orders:
        o, li = read(spark, sf, "orders"), read(spark, sf, "lineitem")
        out += [
            e(o, named("O", "o_orderkey"), PLACED, named("C", "o_custkey")), e(o, named("O", "o_orderkey"), DATE, F.date_format("o_orderdate", "yyyy-MM-dd"), "DateTime-Day"),
            e(li.select("l_orderkey", "l_partkey").distinct(), named("O", "l_orderkey"), CONTAINS, named("P", "l_partkey")), e(li.select("l_orderkey", "l_suppkey").distinct(), named("O", "l_orderkey"), SHIPPED, named("S", "l_suppkey")),
        ]
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    return mirrored(all_)


TREE = [("T:region", "T:place"), ("T:nation", "T:place"), ("T:customer", "T:company"), ("T:supplier", "T:company"), ("T:place", "T:thing"), ("T:company", "T:thing"), ("T:part", "T:thing")]


def edges_sql(orders: bool = True) -> str:
    def e(table, subject, pid, obj, tag="NORMAL"):
        return f"SELECT {subject} AS subject, '{pid}' AS pid, {obj} AS object, '{tag}' AS tag FROM {table}"

    rows = [
        e("nation", "'N' || n_nationkey", PART_OF, "'R' || n_regionkey"), e("customer", "'C' || c_custkey", LOCATED, "'N' || c_nationkey"), e("supplier", "'S' || s_suppkey", LOCATED, "'N' || s_nationkey"),
        e("region", "'R' || r_regionkey", IS_A, "'T:region'"), e("nation", "'N' || n_nationkey", IS_A, "'T:nation'"), e("customer", "'C' || c_custkey", IS_A, "'T:customer'"), e("supplier", "'S' || s_suppkey", IS_A, "'T:supplier'"),
        e("part", "'P' || p_partkey", IS_A, "'T:part'"), e("part", "'P' || p_partkey", KIND, "'T:' || p_type"),
        e("customer", "'C' || c_custkey", SEGMENT, "c_mktsegment", "String"), e("part", "'P' || p_partkey", BRAND, "p_brand", "String"),
        e("customer", "'C' || c_custkey", PRICE, _MONEY.format(c="c_acctbal"), "Quantity-dollar"), e("supplier", "'S' || s_suppkey", PRICE, _MONEY.format(c="s_acctbal"), "Quantity-dollar"),
        *(f"SELECT '{a}', '{SUBCLASS}', '{b}', 'NORMAL'" for a, b in TREE),
    ]
    if orders:
        rows += [
            e("orders", "'O' || o_orderkey", PLACED, "'C' || o_custkey"), e("orders", "'O' || o_orderkey", DATE, "strftime(o_orderdate, '%Y-%m-%d')", "DateTime-Day"),
            e("(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)", "'O' || l_orderkey", CONTAINS, "'P' || l_partkey"), e("(SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)", "'O' || l_orderkey", SHIPPED, "'S' || l_suppkey"),
        ]
    return f"fwd AS ({' UNION ALL '.join(rows)}), edges AS (SELECT subject, pid, object, tag FROM fwd UNION ALL SELECT object, '(-)' || pid, subject, tag FROM fwd WHERE tag = 'NORMAL')"


def words_of(cells_sql: str) -> str:
    """A CTE of the mentions of the supplier tables, after their cells."""
    return f"{cells_sql}, mentions AS (SELECT DISTINCT lower(regexp_replace(trim(value), '\\s+', ' ', 'g')) AS mention FROM cells WHERE row_idx > 0 AND col_idx < 3)"


def units(spark: SparkSession) -> DataFrame:
    rows = [("dollar", "$", "currency", "dollar", 1.0), ("metre", "m", "length", "metre", 1.0), ("kilometre", "km", "length", "metre", 1000.0), ("second", "s", "time", "second", 1.0), ("hour", "h", "time", "second", 3600.0), ("kilogram", "kg", "mass", "kilogram", 1.0), ("gram", "g", "mass", "kilogram", 0.001), ("metre per second", "m/s", "speed", "metre per second", 1.0)]
    return spark.createDataFrame(rows, "name string, symbol string, dimension string, base_unit string, factor double")
