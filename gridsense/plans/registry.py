"""Queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity, typing, values
from ..operators import annotate, cells, columns, graph, lookup
from ..sources.shared import table as stored
from . import small, twins, views
from .twins import WINDOW, ratio_sql, set_parts_sql, set_ratio_sql, windows_sql, words_sql
from .views import C_CELLS, INDEX_SQL, S_CELLS, edges_sql, read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- cells


def _dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in tables of 40 rows; every fourth row is blank, the last column always empty."""
    c = read(spark, sf, "customer")
    blank = F.col("c_custkey") % 4 == 0
    row = F.array(F.when(blank, "  ").otherwise(F.col("c_name")), F.when(blank, "").otherwise(F.col("c_mktsegment")), F.lit(""))
    return c.select(F.floor(F.col("c_custkey") / 40).cast("string").alias("table_id"), (F.col("c_custkey") % 40).cast("int").alias("row_idx"), F.posexplode(row).alias("col_idx", "value"))


_DIRTY = """dirty AS (
  SELECT CAST(c_custkey // 40 AS VARCHAR) AS table_id, CAST(c_custkey % 40 AS INT) AS row_idx, 0 AS col_idx, CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE c_name END AS value FROM customer
  UNION ALL SELECT CAST(c_custkey // 40 AS VARCHAR), CAST(c_custkey % 40 AS INT), 1, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END FROM customer
  UNION ALL SELECT CAST(c_custkey // 40 AS VARCHAR), CAST(c_custkey % 40 AS INT), 2, '' FROM customer)"""


@query(f"""WITH {_DIRTY}, k AS (SELECT table_id, row_idx, row_number() OVER (PARTITION BY table_id ORDER BY row_idx) - 1 AS n FROM dirty GROUP BY table_id, row_idx HAVING max(trim(value, ' ')) <> '')
SELECT table_id, CAST(n AS INT) AS row_idx, col_idx, value FROM dirty JOIN k USING (table_id, row_idx)""")
def clean_rows(spark: SparkSession, sf: str) -> DataFrame:
    return cells.drop_blank_rows(_dirty(spark, sf))


@query(f"""WITH {_DIRTY}, k AS (SELECT table_id, col_idx, row_number() OVER (PARTITION BY table_id ORDER BY col_idx) - 1 AS n FROM dirty GROUP BY table_id, col_idx HAVING max(value) <> '')
SELECT table_id, row_idx, CAST(n AS INT) AS col_idx, value FROM dirty JOIN k USING (table_id, col_idx)""")
def drop_null_columns(spark: SparkSession, sf: str) -> DataFrame:
    return cells.drop_empty_columns(_dirty(spark, sf))


@query("""WITH w AS (SELECT CAST(p_partkey // 40 AS VARCHAR) AS table_id, CAST(p_partkey % 40 AS INT) AS row_idx, p_partkey % 3 AS last, [p_name, p_brand, p_type] AS v FROM part),
t AS (SELECT table_id, max(last) AS w FROM w GROUP BY table_id)
SELECT table_id, row_idx, CAST(c AS INT) AS col_idx, CASE WHEN c <= last THEN v[c + 1] ELSE '' END AS value FROM w JOIN t USING (table_id), range(3) r(c) WHERE c <= t.w""")
def pad_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    row = F.slice(F.array("p_name", "p_brand", "p_type"), F.lit(1), (F.col("p_partkey") % 3 + 1).cast("int"))
    ragged = p.select(F.floor(F.col("p_partkey") / 40).cast("string").alias("table_id"), (F.col("p_partkey") % 40).cast("int").alias("row_idx"), F.posexplode(row).alias("col_idx", "value"))
    return cells.pad(ragged)


@query(f"WITH {S_CELLS} SELECT table_id, col_idx AS row_idx, row_idx AS col_idx, value FROM cells")
def transpose_cells(spark: SparkSession, sf: str) -> DataFrame:
    return cells.transpose(views.supplier_cells(spark, sf))


@query("""WITH r AS (SELECT CAST(c_custkey // 1000 AS VARCHAR) AS table_id, CAST(c_custkey % 1000 AS INT) AS row_idx, c_name FROM customer),
k AS (SELECT *, count(*) OVER (PARTITION BY table_id) AS n, row_number() OVER (PARTITION BY table_id ORDER BY CASE WHEN row_idx >= 10 THEN 1 ELSE 0 END, CASE WHEN row_idx >= 10 THEN md5(table_id || ':' || row_idx || ':0') END NULLS FIRST, row_idx) AS k FROM r)
SELECT table_id, CAST(row_number() OVER (PARTITION BY table_id ORDER BY row_idx) - 1 AS INT) AS row_idx, 0 AS col_idx, c_name AS value FROM k WHERE n <= 400 OR k <= 400""")
def sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    return cells.sample(c.select(F.floor(F.col("c_custkey") / 1000).cast("string").alias("table_id"), (F.col("c_custkey") % 1000).cast("int").alias("row_idx"), F.lit(0).alias("col_idx"), F.col("c_name").alias("value")))


# --- typing


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    forms = [
        size, F.concat(size, F.lit("-"), size), F.concat(F.lit("("), size, F.lit(","), size, F.lit(")")), F.concat(size, F.lit("%")), F.concat(F.lit("10.0."), size, F.lit("."), (key % 256).cast("string")),
        (key % 1500 + 900).cast("string"), F.when(key % 2 == 0, "Yes").otherwise("off"), F.concat(F.lit("-"), size, F.lit(".5")), F.col("p_brand"), F.concat(F.lit("+4420"), F.lpad(key.cast("string"), 8, "7")),
    ]
    return p.select(F.explode(F.array(*forms)).alias("value")).distinct()


_SAMPLES = """samples AS (SELECT DISTINCT unnest([CAST(p_size AS VARCHAR), p_size || '-' || p_size, '(' || p_size || ',' || p_size || ')', p_size || '%', '10.0.' || p_size || '.' || (p_partkey % 256),
  CAST(p_partkey % 1500 + 900 AS VARCHAR), CASE WHEN p_partkey % 2 = 0 THEN 'Yes' ELSE 'off' END, '-' || p_size || '.5', p_brand, '+4420' || lpad(CAST(p_partkey AS VARCHAR), 8, '7')]) AS value FROM part)"""
_OCT = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|0[0-9]{1,2})"
_LABELS = rf"""list_filter([
  CASE WHEN regexp_full_match(value, '\+44[1-9][0-9]{{8,9}}') THEN 'PHONE NUMBER' END,
  CASE WHEN regexp_full_match(value, '[0-9]+') AND try_cast(value AS BIGINT) BETWEEN 1000 AND 2022 THEN 'DATE' END,
  CASE WHEN regexp_full_match(value, '[0-9]+[.,]?[0-9]*-+[0-9]+[.,]?[0-9]*') OR regexp_full_match(value, '\([0-9]+[.,]?[0-9]*,+[0-9]+[.,]?[0-9]*\)') THEN 'RANGE' END,
  CASE WHEN regexp_full_match(value, '[+-]?[0-9]+[.,]?[0-9]*') THEN 'CARDINAL' END,
  CASE WHEN regexp_full_match(value, '([0-9]+[.,]?[0-9]*|\.[0-9]+)%') THEN 'PERCENT' END,
  CASE WHEN regexp_full_match(value, '{_OCT}\.{_OCT}\.{_OCT}\.{_OCT}') THEN 'IP ADDRESS' END,
  CASE WHEN regexp_full_match(lower(value), 'true|false|on|off|yes|no') THEN 'BOOLEAN' END], lambda x: x IS NOT NULL)"""


@query(f"WITH {_SAMPLES}, l AS (SELECT value, {_LABELS} AS ls FROM samples) SELECT value, CASE WHEN len(ls) = 0 THEN 'UNKNOWN' ELSE array_to_string(ls, '|') END AS labels FROM l")
def cell_typing_regex(spark: SparkSession, sf: str) -> DataFrame:
    return typing.type_values(_samples(spark, sf)).select("value", F.array_join("labels", "|").alias("labels"))


@query(f"""WITH {_SAMPLES} SELECT value, CASE WHEN length(value) >= 100 THEN 'String_Normal' WHEN 2 * length(regexp_replace(value, '[^0-9]', '', 'g')) >= length(value) THEN 'String_Number'
WHEN upper(value) = value THEN 'String_Uppercase' ELSE 'String_Normal' END AS kind,
CAST(len(list_distinct(regexp_extract_all(value, '[[:punct:]]'))) AS INT) AS signs, CAST(len(list_filter(string_split(value, ' '), lambda w: w <> '')) AS INT) AS words FROM samples""")
def string_types(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return _samples(spark, sf).select("value", values.string_type(v).alias("kind"), values.punctuation_kinds(v).alias("signs"), values.word_count(v).alias("words"))


_TYPED = r"""typed AS (SELECT *, CASE WHEN regexp_full_match(value, '-?[0-9]+[.][0-9]+') THEN 'CARDINAL' ELSE 'UNKNOWN' END AS label,
  CASE WHEN regexp_full_match(value, '-?[0-9]+[.][0-9]+') THEN 'CARDINAL' WHEN 2 * length(regexp_replace(value, '[^0-9]', '', 'g')) >= length(value) THEN 'String_Number'
  WHEN upper(value) = value THEN 'String_Uppercase' ELSE 'String_Normal' END AS dtype FROM cells)"""


@query(f"""WITH {C_CELLS}, {_TYPED}, c AS (SELECT table_id, col_idx, label, count(*) AS n FROM typed WHERE row_idx > 0 GROUP BY ALL)
SELECT table_id, col_idx, label, round(n / CAST(sum(n) OVER (PARTITION BY table_id, col_idx) AS DOUBLE), 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY table_id, col_idx ORDER BY n DESC, label) = 1""")
def column_typing_topk(spark: SparkSession, sf: str) -> DataFrame:
    t = views.customer_cells(spark, sf)
    return columns.column_types(t, typing.type_values(t), "labels", 1).select("table_id", "col_idx", "label", F.round("score", 6).alias("score"))


@query(f"""WITH {C_CELLS}, {_TYPED}, c AS (SELECT table_id, row_idx, dtype, count(*) AS n FROM typed WHERE row_idx > 0 AND col_idx > 0 GROUP BY ALL),
p AS (SELECT table_id, row_idx, power(avg(1 - power(1 - 2 * n / t, 2)), 2) AS h FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY table_id, row_idx) AS DOUBLE) AS t FROM c) GROUP BY table_id, row_idx)
SELECT table_id, round(avg(h), 6) AS mean, round(stddev_samp(h), 6) AS std FROM p GROUP BY table_id HAVING count(*) > 1""")
def row_heterogeneity(spark: SparkSession, sf: str) -> DataFrame:
    t = views.customer_cells(spark, sf)
    return columns.heterogeneity(t, typing.type_values(t), "row_idx").where("mean is not null").select("table_id", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"""WITH {C_CELLS}, l AS (SELECT table_id, col_idx, count(*) AS n, count(*) FILTER (value <> '') AS f, stddev_pop(length(value)) FILTER (value <> '') AS s FROM cells GROUP BY ALL)
SELECT table_id, round(avg(coalesce(s, 0)), 6) AS spread FROM l WHERE 2 * f >= n GROUP BY table_id""")
def length_spread(spark: SparkSession, sf: str) -> DataFrame:
    return columns.length_spread(views.customer_cells(spark, sf), "col_idx").select("table_id", F.round("spread", 6).alias("spread"))


@query(f"""WITH {C_CELLS} SELECT table_id, col_idx, round(count(DISTINCT value) FILTER (value <> '') / CAST(count(*) AS DOUBLE), 6) AS unique_ratio, round(count(*) FILTER (value = '') / CAST(count(*) AS DOUBLE), 6) AS empty_ratio,
round(avg(len(list_filter(string_split(value, ' '), lambda w: w <> ''))), 6) AS avg_words FROM cells GROUP BY ALL""")
def column_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    return columns.uniqueness(views.customer_cells(spark, sf)).select("table_id", "col_idx", *(F.round(c, 6).alias(c) for c in ("unique_ratio", "empty_ratio", "avg_words")))


def _prepared(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Customers as they are, turned, without their header row, and of two rows."""
    t = stored(views.customer_cells(spark, sf), "cells")
    name = lambda letter: F.concat(F.lit(letter), "table_id")
    turned = cells.transpose(t).withColumn("table_id", name("T"))
    bare = t.where("row_idx > 0").withColumn("row_idx", F.col("row_idx") - 1).withColumn("table_id", name("B"))
    two = t.where("row_idx < 2").withColumn("table_id", name("W"))
    return columns.preprocess(t.unionByName(turned).unionByName(bare).unionByName(two))


@query(twins.ORIENTATION)
def orientation(spark: SparkSession, sf: str) -> DataFrame:
    return _prepared(spark, sf)["orientation"]


@query(twins.HEADER)
def header_score(spark: SparkSession, sf: str) -> DataFrame:
    return _prepared(spark, sf)["header"]


@query(twins.KEY)
def key_column(spark: SparkSession, sf: str) -> DataFrame:
    return _prepared(spark, sf)["key"]


# --- similarity


_PAIRS = f"pairs AS (SELECT DISTINCT {views._NOISE.format(k='c_custkey', n='c_name')} AS a, 'Customer#00000' || lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS b FROM customer UNION SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT n_name || ' of ' || r_name, r_name || ' ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").select(views.noisy(F.col("c_name"), F.col("c_custkey")).alias("a"), F.concat(F.lit("Customer#00000"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0")).alias("b"))
    n = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.union(n.select("n_name", "r_name")).union(n.select(F.concat("n_name", F.lit(" of "), "r_name"), F.concat("r_name", F.lit(" "), "n_name"))).distinct()


@query(f"WITH {_PAIRS} SELECT a, b, round({ratio_sql('a', 'b')}, 6) AS ratio FROM pairs")
def sim_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("a", "b", F.round(similarity.ratio("a", "b"), 6).alias("ratio"))


@query(f"WITH {_PAIRS}, s AS (SELECT a, b, array_to_string(list_sort(string_split(a, ' ')), ' ') AS x, array_to_string(list_sort(string_split(b, ' ')), ' ') AS y FROM pairs) SELECT a, b, round({ratio_sql('x', 'y')}, 6) AS ratio FROM s")
def sim_token_sort(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("a", "b", F.round(similarity.token_sort_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query(f"""WITH {_PAIRS}, t AS (SELECT a, b, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM pairs),
u AS (SELECT *, list_sort(list_intersect(x, y)) AS c, list_sort(list_filter(x, lambda w: NOT list_contains(y, w))) AS l, list_sort(list_filter(y, lambda w: NOT list_contains(x, w))) AS r FROM t),
v AS (SELECT *, array_to_string(c, ' ') AS base, array_to_string(list_concat(c, l), ' ') AS one, array_to_string(list_concat(c, r), ' ') AS two FROM u)
SELECT a, b, round(CASE WHEN len(c) > 0 AND (len(l) = 0 OR len(r) = 0) THEN 1.0 WHEN len(c) > 0 THEN greatest({ratio_sql('base', 'one')}, {ratio_sql('base', 'two')}, {ratio_sql('one', 'two')}) ELSE {ratio_sql('one', 'two')} END, 6) AS ratio FROM v""")
def sim_token_set(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("a", "b", F.round(similarity.token_set_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


_LOW = f"SELECT k, a, b, lower(a) AS x, lower(b) AS y, list_distinct({words_sql('lower(a)')}) AS xs, list_distinct({words_sql('lower(b)')}) AS ys, array_to_string(list_sort({words_sql('lower(a)')}), ' ') AS x_sorted, array_to_string(list_sort({words_sql('lower(b)')}), ' ') AS y_sorted FROM numbered"


@query(f"""WITH {_PAIRS}, numbered AS MATERIALIZED (SELECT row_number() OVER () AS k, a, b FROM pairs), stretch AS (SELECT k, max({ratio_sql('x', 'v')}) AS p FROM (SELECT *, {WINDOW} AS v FROM ({windows_sql('numbered')})) GROUP BY k),
low AS (SELECT *, {set_parts_sql('xs', 'ys', 't')} FROM ({_LOW})), three AS (SELECT k, a, b, {ratio_sql('x', 'y')} AS r1, {ratio_sql('x_sorted', 'y_sorted')} AS r2, {set_ratio_sql('xs', 'ys', 't')} AS r3 FROM low)
SELECT a, b, round(p, 6) AS ratio, round((r1 + r2 + r3 - least(r1, r2, r3)) / 2, 6) AS textual FROM three JOIN stretch USING (k)""")
def sim_partial(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("a", "b", F.round(similarity.partial_ratio("a", "b"), 6).alias("ratio"), F.round(similarity.textual_similarity(F.col("a"), F.col("b")), 6).alias("textual"))


# --- lookup


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.label_documents(views.label_dump(spark, sf))


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    t = views.supplier_cells(spark, sf).where("row_idx > 0 and col_idx < 3")
    return t.select(similarity.normalise_label(F.col("value")).alias("mention")).distinct()


_MENTIONS = views.words_of(S_CELLS)


@query(f"WITH {INDEX_SQL} SELECT entity, label, origin, CAST(length(label) AS INT) AS length, pr FROM index_")
def alias_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).select("entity", "label", "origin", "length", "pr")


@query(f"WITH {INDEX_SQL}, {_MENTIONS} SELECT DISTINCT mention, entity, origin FROM mentions JOIN index_ ON lower(regexp_replace(trim(label), '\\s+', ' ', 'g')) = mention")
def lookup_exact(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.exact(_mentions(spark, sf), _index(spark, sf))


@query(twins.BM25.replace("{mentions}", _MENTIONS))
def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    index = _index(spark, sf)
    return lookup.hits(_mentions(spark, sf), index).select("mention", "entity", "label", "origin", F.round("bm25", 5).alias("bm25"))


@query(twins.LOOKUP.replace("{mentions}", _MENTIONS))
def lookup_fuzzy_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.lookup(_mentions(spark, sf), _index(spark, sf), 20).select("mention", "entity", "label", "origin", F.round("ratio", 6).alias("ratio"), "partial", F.round("score", 6).alias("score"), "rank")


# --- graph


@query(f"WITH {edges_sql()} SELECT subject AS entity, count(*) AS num_edges FROM edges GROUP BY subject")
def kg_degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(views.edges(spark, sf))


@query(f"WITH {edges_sql()} SELECT subject AS entity, round(1 / (2 + log10(2 + count(*))), 6) AS popularity FROM edges GROUP BY subject")
def node_popularity(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(views.edges(spark, sf)).select("entity", F.round(values.popularity(F.col("num_edges")), 6).alias("popularity"))


@query(f"""WITH {edges_sql()}, own AS (SELECT DISTINCT subject AS entity, object AS type FROM edges WHERE pid = 'P106'),
l1 AS (SELECT * FROM own UNION SELECT subject, object FROM edges WHERE pid = 'P31' AND subject NOT IN (SELECT entity FROM own)),
up AS (SELECT DISTINCT subject AS type, object AS above FROM edges WHERE pid = 'P279'), l2 AS (SELECT DISTINCT entity, above AS type FROM l1 JOIN up USING (type)), l3 AS (SELECT DISTINCT entity, above AS type FROM l2 JOIN up USING (type))
SELECT entity, type, 1 AS level FROM l1 UNION ALL SELECT entity, type, 2 FROM l2 UNION ALL SELECT entity, type, 3 FROM l3""")
def types_by_level(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf)
    return graph.types_by_level(e.select(F.col("subject").alias("entity")), e)


@query(f"WITH {edges_sql()} SELECT DISTINCT subject AS type, object AS neighbour FROM edges WHERE tag = 'NORMAL' AND pid <> '(-)P31' AND subject LIKE 'T:%'")
def type_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf)
    return graph.type_neighbours(e.where(F.col("subject").startswith("T:")).select(F.col("subject").alias("type")), e)


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """The whole graph, written once, as several steps read it."""
    return stored(views.edges(spark, sf), "edges")


def _entity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    s, n = read(spark, sf, "supplier"), read(spark, sf, "nation")
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"])
    sup, nat, reg = views.named("S", "s_suppkey"), views.named("N", "n_nationkey"), views.named("R", "n_regionkey")
    return j.select(F.explode(F.array(*[F.struct(a.alias("head"), b.alias("tail")) for a, b in ((sup, nat), (nat, reg), (sup, reg))])).alias("p")).select("p.*").distinct()


_EPAIRS = "pairs AS (SELECT 'S' || s_suppkey AS head, 'N' || n_nationkey AS tail FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT 'S' || s_suppkey, 'R' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
@query(f"WITH {edges_sql()}, {_EPAIRS} SELECT DISTINCT head, tail, pid AS path, 1.0::DOUBLE AS prox FROM pairs JOIN edges ON subject = head AND object = tail WHERE tag = 'NORMAL'")
def direct_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.direct_paths(_entity_pairs(spark, sf), _edges(spark, sf))


@query(f"WITH {edges_sql()}, {_EPAIRS}, {twins.HOPS} SELECT head, tail, path, round(min(prox), 6) AS prox FROM two GROUP BY ALL UNION ALL SELECT head, tail, path, 1.0 FROM d")
def two_hop_paths(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf)
    return graph.paths(_entity_pairs(spark, sf), e, graph.degrees(e)).select("head", "tail", "path", F.round("prox", 6).alias("prox"))


# --- values


@query("""WITH d AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS a, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%Y-01-02') END AS b, o_orderkey % 3 AS k FROM orders)
SELECT a, b, CASE WHEN k < 2 OR a = b THEN 1.0 ELSE 0.8 END::DOUBLE AS score FROM d""")
def literal_date_match(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey") % 3
    f = lambda p: F.date_format("o_orderdate", p)
    d = o.select(f("yyyy-MM-dd").alias("a"), F.when(k == 0, f("yyyy")).when(k == 1, f("MM/dd/yyyy")).otherwise(F.concat(f("yyyy"), F.lit("-01-02"))).alias("b"), k.alias("k")).distinct()
    return d.select("a", "b", values.date_score(F.col("a"), F.col("b")).cast("double").alias("score"))


@query("SELECT p_partkey, round(1 - abs(p_retailprice - p_size) / (abs(p_retailprice) + abs(p_size) + 1e-4), 6) AS sim, CAST(p_size AS DOUBLE) AS parsed FROM part")
def quantity_match(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    parsed = values.float_parse(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(",")))
    return p.select("p_partkey", F.round(values.number_similarity(F.col("p_retailprice"), parsed), 6).alias("sim"), parsed.alias("parsed"))


# --- annotation


def _kinds(spark: SparkSession, t: DataFrame) -> DataFrame:
    return t.select("table_id", "col_idx").distinct().select("table_id", "col_idx", F.when(F.col("col_idx") < 3, "entity").otherwise("without_unit").alias("kind"))


def _exact_candidates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = views.supplier_cells(spark, sf).where("row_idx > 0")
    ranked = lookup.exact(t.where("col_idx < 3").select(F.col("value").alias("mention")), _index(spark, sf)).where("origin = 'LABEL'").select("mention", "entity", F.lit(1).alias("rank"), F.lit(1.0).alias("score"))
    kinds = _kinds(spark, t)
    return t, kinds, annotate.candidates(t, kinds, ranked)


_CAND = f"{S_CELLS}, {INDEX_SQL}, {edges_sql()}, cand AS (SELECT table_id, row_idx, col_idx, entity FROM cells JOIN index_ ON lower(value) = lower(label) WHERE row_idx > 0 AND col_idx < 3 AND origin = 'LABEL'), n AS (SELECT table_id, count(DISTINCT row_idx) AS n FROM cells WHERE row_idx > 0 GROUP BY table_id)"


@query(twins.FIRST)
def cea_first_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Fuzzy candidates before any relation is known."""
    t = stored(views.supplier_cells(spark, sf).where("row_idx > 0"), "cells")
    kinds = _kinds(spark, t)
    cand = annotate.candidates(t, kinds, lookup.lookup(annotate.mentions(t, kinds), _index(spark, sf), 20))
    return annotate.cea(annotate.first_scores(cand, kinds), False).withColumn("score", F.round("score", 6))


@query(f"""WITH {_CAND}, pc AS (SELECT a.table_id, a.row_idx, a.col_idx AS h, b.col_idx AS t, a.entity AS head, b.entity AS tail FROM cand a JOIN cand b ON a.table_id = b.table_id AND a.row_idx = b.row_idx AND a.col_idx < b.col_idx AND a.entity <> b.entity),
pairs AS (SELECT DISTINCT head, tail FROM pc), {twins.HOPS},
paths AS (SELECT head, tail, path, min(prox) AS prox, max(max(prox)) OVER (PARTITION BY head, tail) AS best FROM (SELECT head, tail, path, prox FROM two UNION ALL SELECT head, tail, path, 1.0 FROM d) GROUP BY head, tail, path),
r AS (SELECT table_id, h, t, row_idx, path, 0.1 * max(prox) AS s, min(prox) AS prox FROM pc JOIN paths USING (head, tail) WHERE best > 0.1 GROUP BY ALL),
v AS (SELECT table_id, h, t, path, count(*) AS cnt, sum(s) AS tot, min(prox) AS prox FROM r GROUP BY ALL)
SELECT table_id, CAST(h AS INT) AS head, CAST(t AS INT) AS tail, path, round(tot / n, 6) AS score, round(cnt / CAST(n AS DOUBLE), 6) AS coverage, round(prox, 6) AS prox FROM v JOIN n USING (table_id)
QUALIFY cnt >= first_value(cnt) OVER (PARTITION BY table_id, h, t ORDER BY round(cnt * tot, 9) DESC, cnt DESC, prox DESC, contains(path, '::'), starts_with(path, '(-)'), path)""")
def cpa_votes(spark: SparkSession, sf: str) -> DataFrame:
    t, kinds, cand = _exact_candidates(spark, sf)
    e = _edges(spark, sf)
    ctx = annotate.context(cand, t, kinds, e, graph.degrees(e))
    n = t.groupBy("table_id").agg(F.count_distinct("row_idx").cast("double").alias("n"))
    first = annotate.cea(annotate.first_scores(cand, kinds), False)
    return annotate.cpa(first, t, kinds, ctx.links, n, False).select("table_id", "head", "tail", "path", *(F.round(c, 6).alias(c) for c in ("score", "coverage", "prox")))


@query(f"""WITH {_CAND}, up AS (SELECT DISTINCT subject AS type, object AS above FROM edges WHERE pid = 'P279'), l1 AS (SELECT DISTINCT subject AS entity, object AS type FROM edges WHERE pid = 'P31'),
l2 AS (SELECT DISTINCT entity, above AS type FROM l1 JOIN up USING (type)), l3 AS (SELECT DISTINCT entity, above AS type FROM l2 JOIN up USING (type)),
types AS (SELECT entity, type, 1.0 AS w FROM l1 UNION ALL SELECT entity, type, 0.7 FROM l2 UNION ALL SELECT entity, type, 0.2 FROM l3),
r AS (SELECT table_id, col_idx, row_idx, type, max(w * 0.1) AS s FROM cand JOIN types USING (entity) GROUP BY ALL), v AS (SELECT table_id, col_idx, type, count(*) AS cnt, sum(s) AS tot FROM r GROUP BY ALL)
SELECT table_id, CAST(col_idx AS INT) AS col_idx, type, round(tot / n, 6) AS score, round(cnt / CAST(n AS DOUBLE), 6) AS coverage FROM v JOIN n USING (table_id)
QUALIFY cnt >= first_value(cnt) OVER (PARTITION BY table_id, col_idx ORDER BY round(cnt * tot, 9) DESC, type)""")
def cta_votes(spark: SparkSession, sf: str) -> DataFrame:
    t, kinds, cand = _exact_candidates(spark, sf)
    e = _edges(spark, sf)
    n = t.groupBy("table_id").agg(F.count_distinct("row_idx").cast("double").alias("n"))
    first = annotate.cea(annotate.first_scores(cand, kinds), False)
    return annotate.cta(first, graph.types_by_level(cand, e), n, False).select("table_id", "col_idx", "type", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))


@query(f"WITH {_CAND} SELECT DISTINCT table_id, CAST(h AS INT) AS head, 3 AS tail FROM n, range(1, 3) r(h)")
def unrelated_pairs(spark: SparkSession, sf: str) -> DataFrame:
    t = views.supplier_cells(spark, sf).where("row_idx > 0")
    known = t.select("table_id").distinct().select("table_id", F.lit(0).alias("head"), F.lit(3).alias("tail"), F.lit(1).alias("rank"), F.lit(0.5).alias("coverage"))
    return annotate.unrelated_pairs(_kinds(spark, t), known)


def annotated(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Supplier tables with noisy names: preprocessing, fuzzy lookup, four rounds."""
    whole = stored(views.supplier_cells(spark, sf), "cells")
    typed = stored(typing.type_values(whole), "typing")
    body = whole.where("row_idx > 0")
    kinds = stored(annotate.classify_columns(body, columns.column_types(whole, typed, "labels", 3)), "kinds")
    ranked = stored(lookup.lookup(annotate.mentions(body, kinds), stored(_index(spark, sf), "index"), 20), "ranked")
    kinds = stored(annotate.demote(body, kinds, ranked), "kinds")
    # not written: of the views over the star schema each step reads only those that have what it asks for
    e = views.edges(spark, sf)
    asked = stored(ranked.select("entity").distinct(), "asked")
    types = stored(graph.types_by_level(graph.few(asked), e), "types")
    return annotate.annotate(body, kinds, ranked, e, types, graph.supertypes(e), units=views.units(spark))


@query(twins.CEA)
def annotate_cea(spark: SparkSession, sf: str) -> DataFrame:
    return annotated(spark, sf)["cea"].withColumn("score", F.round("score", 6))


@query(twins.CTA)
def annotate_cta(spark: SparkSession, sf: str) -> DataFrame:
    return annotated(spark, sf)["cta"].withColumn("score", F.round("score", 6))


@query(twins.CPA)
def annotate_cpa(spark: SparkSession, sf: str) -> DataFrame:
    return annotated(spark, sf)["cpa"].withColumn("score", F.round("score", 6))


QUERIES |= small.QUERIES
ORACLE |= small.ORACLE
