"""Queries of single operators (values, graph, sources, sinks) with SQL twins; see `registry`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import typing, units, values
from ..functions.similarity import normalise_label
from ..model import CURRENCIES, CURRENCY_CLASS, INSTANCE_OF, UNIT_SYMBOL, LookupConfig
from ..operators import annotate, cells, columns, graph, lookup
from ..sources import readers, sinks
from ..sources.shared import folder
from ..sources.shared import table as stored
from . import twins, views
from .views import S_CELLS, edges_sql, read, words_of

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


# --- values


@query(r"""WITH v AS (SELECT DISTINCT unnest([p_name, '', '--', '!', repeat('.', CAST(p_size AS INT)), substr(p_name, 1, 1), 'é', '-' || p_size, CAST(p_size % 10 AS VARCHAR)]) AS value FROM part)
SELECT value, value <> '' AND NOT regexp_full_match(value, '(-+|!+|[.]+)') AND NOT (length(value) = 1 AND NOT regexp_full_match(value, '[0-9A-Za-z]')) AS typable FROM v""")
def typability(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    size = F.col("p_size").cast("string")
    forms = F.array("p_name", F.lit(""), F.lit("--"), F.lit("!"), F.expr("repeat('.', cast(p_size as int))"), F.substring("p_name", 1, 1), F.lit("é"), F.concat(F.lit("-"), size), (F.col("p_size") % 10).cast("string"))
    return p.select(F.explode(forms).alias("value")).distinct().select("value", typing.typable(F.col("value")).alias("typable"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS table_id, CAST(0 AS INT) AS row_idx, CAST(c AS INT) AS col_idx, [p_name, p_brand || ' café', 'naïve ' || p_type, 'plain'][c + 1] AS value FROM part, range(4) r(c)")
def encoding_repair(spark: SparkSession, sf: str) -> DataFrame:
    """UTF-8 read as Latin-1, and escapes, are undone."""
    p = read(spark, sf, "part")
    row = F.array(F.col("p_name"), F.concat("p_brand", F.lit(" cafÃ©")), F.concat(F.lit("na\\xefve "), "p_type"), F.lit("plain"))
    return cells.repair(p.select(F.col("p_partkey").cast("string").alias("table_id"), F.lit(0).alias("row_idx"), F.posexplode(row).alias("col_idx", "value")))


@query("""WITH o AS (SELECT DISTINCT strftime(o_orderdate, '%Y') AS y, o_orderkey % 5 AS k FROM orders)
SELECT y, k, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.0 ELSE 0.0 END::DOUBLE AS score FROM o""")
def period_match(spark: SparkSession, sf: str) -> DataFrame:
    """Periods against cells of two dates, parted by an en dash, a word, a minus sign; another end; one date."""
    o = read(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy").alias("y"), (F.col("o_orderkey") % 5).alias("k")).distinct()
    later = (F.col("y").cast("int") + 2).cast("string")
    cell = F.when(F.col("k") == 0, F.concat("y", F.lit("–"), later)).when(F.col("k") == 1, F.concat("y", F.lit(" to "), later)).when(F.col("k") == 2, F.concat("y", F.lit(" − "), later)).when(F.col("k") == 3, F.concat("y", F.lit(" - "), (F.col("y").cast("int") + 3).cast("string"))).otherwise(F.col("y"))
    return o.select("y", "k", values.period_score(F.concat("y", F.lit(":"), later), cell).alias("score"))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y') AS a, strftime(o_orderdate, '%Y-%m') AS b, strftime(o_orderdate, '%Y') AS c FROM orders")
def graph_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates of the graph without their empty parts."""
    o = read(spark, sf, "orders")
    f = lambda p: F.date_format("o_orderdate", p)
    clean = values.clean_date
    return o.select(clean(F.concat(f("yyyy"), F.lit("-00-00"))).alias("a"), f("yyyy-MM").alias("b"), clean(F.concat(f("yyyy"), F.lit("-01-01"))).alias("c")).distinct()


@query("""SELECT p_partkey AS k, 'http://www.wikidata.org/entity/Q' || p_partkey AS entity, 'http://www.wikidata.org/prop/direct/P' || p_partkey AS property, p_name AS other, true AS is_q, false AS is_name FROM part""")
def entity_names(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    q, pid = views.named("Q", "p_partkey"), views.named("P", "p_partkey")
    return p.select(F.col("p_partkey").alias("k"), values.prefixed(q).alias("entity"), values.prefixed(pid).alias("property"), values.prefixed(F.col("p_name")).alias("other"), values.is_id(q).alias("is_q"), values.is_id(F.col("p_name")).alias("is_name"))


@query("SELECT tag, CASE tag WHEN 'PREFERRED' THEN 2 WHEN 'NORMAL' THEN 1 ELSE 0 END AS weight, count(*) AS n FROM (SELECT ['PREFERRED', 'NORMAL', 'DEPRECATED', 'String'][CAST(p_partkey % 4 + 1 AS INT)] AS tag FROM part) GROUP BY tag")
def statement_ranks(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    tags = F.array(*map(F.lit, ("PREFERRED", "NORMAL", "DEPRECATED", "String")))
    tag = F.element_at(tags, (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select(tag.alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).select("tag", values.rank_weight(F.col("tag")).alias("weight"), "n")


# --- quantities

_MEASURES = """measures AS (SELECT p_partkey AS k, p_size AS z, CASE p_partkey % 6 WHEN 0 THEN p_size || ' km' WHEN 1 THEN p_size || '000 m' WHEN 2 THEN p_size || ' h' WHEN 3 THEN '$' || p_size || ',500.25' WHEN 4 THEN p_size || ' kg' ELSE p_name END AS value FROM part)"""


def _measures(spark: SparkSession, sf: str) -> DataFrame:
    p, size = read(spark, sf, "part"), F.col("p_size").cast("string")
    k = F.col("p_partkey") % 6
    text = F.when(k == 0, F.concat(size, F.lit(" km"))).when(k == 1, F.concat(size, F.lit("000 m"))).when(k == 2, F.concat(size, F.lit(" h"))).when(k == 3, F.concat(F.lit("$"), size, F.lit(",500.25"))).when(k == 4, F.concat(size, F.lit(" kg")))
    return p.select(F.col("p_partkey").alias("k"), F.coalesce(text, F.col("p_name")).alias("value"))


@query(f"""WITH {_MEASURES} SELECT DISTINCT value, CASE WHEN k % 6 < 2 THEN 'metre' WHEN k % 6 = 2 THEN 'second' WHEN k % 6 = 3 THEN 'dollar' ELSE 'kilogram' END AS base_unit,
round(CASE WHEN k % 6 < 2 THEN z * 1000.0 WHEN k % 6 = 2 THEN z * 3600.0 WHEN k % 6 = 3 THEN z * 1000 + 500.25 ELSE z END::DOUBLE, 4) AS amount FROM measures WHERE k % 6 < 5""")
def base_units(spark: SparkSession, sf: str) -> DataFrame:
    return units.quantities(_measures(spark, sf), views.units(spark)).withColumn("amount", F.round("amount", 4))


@query(f"""WITH {_MEASURES} SELECT DISTINCT value, CASE WHEN k % 6 < 2 THEN 'DISTANCE' WHEN k % 6 = 2 THEN 'DURATION' WHEN k % 6 = 3 THEN 'MONEY' WHEN k % 6 = 4 THEN 'MASS' ELSE 'UNKNOWN' END AS labels FROM measures""")
def unit_typing(spark: SparkSession, sf: str) -> DataFrame:
    return typing.type_values(_measures(spark, sf), views.units(spark)).select("value", F.array_join("labels", "|").alias("labels"))


_RATES = ", ".join(f"('{n}', {f})" for n, f in CURRENCIES.items())


@query(f"SELECT p_size || ' ' || name AS value, round(p_size * rate, 4) AS amount FROM (SELECT DISTINCT p_size FROM part), (VALUES {_RATES}) c(name, rate)")
def currencies(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts of every known currency, in dollars."""
    dim = units.currency_units(spark)
    sizes = read(spark, sf, "part").select(F.col("p_size").cast("string").alias("z")).distinct()
    # nine currencies
    text = sizes.crossJoin(F.broadcast(dim.select("name"))).select(F.concat("z", F.lit(" "), "name").alias("value"))
    return units.quantities(text, dim).select("value", F.round("amount", 4).alias("amount"))


# --- typed columns

_SHEET = """sheet AS (SELECT 'P' || (p_partkey // 20) AS table_id, CAST(p_partkey % 20 AS INT) AS row_idx, CAST(c AS INT) AS col_idx, [CAST(p_partkey % 20 + 1 AS VARCHAR), CAST(1900 + p_size AS VARCHAR), p_size || '%', p_size || '.5', repeat(p_name || ' ', 30), p_name,
  CASE WHEN p_partkey % 5 < 2 THEN CAST(1900 + p_size AS VARCHAR) WHEN p_partkey % 5 = 2 THEN p_size || '%' WHEN p_partkey % 5 = 3 THEN 'yes' ELSE p_name END, '{};:!#' || p_size || 'x'][c + 1] AS value FROM part, range(8) r(c))"""


def _sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Parts in tables of 20 rows without a header: a count, years, shares, numbers, long texts, names, a mix, signs."""
    p, size, k = read(spark, sf, "part"), F.col("p_size").cast("string"), F.col("p_partkey")
    year = (1900 + F.col("p_size")).cast("int").cast("string")
    mix = F.when(k % 5 < 2, year).when(k % 5 == 2, F.concat(size, F.lit("%"))).when(k % 5 == 3, "yes").otherwise(F.col("p_name"))
    row = F.array((k % 20 + 1).cast("string"), year, F.concat(size, F.lit("%")), F.concat(size, F.lit(".5")), F.repeat(F.concat("p_name", F.lit(" ")), 30), F.col("p_name"), mix, F.concat(F.lit("{};:!#"), size, F.lit("x")))
    return p.select(F.concat(F.lit("P"), F.floor(k / 20).cast("string")).alias("table_id"), (k % 20).cast("int").alias("row_idx"), F.posexplode(row).alias("col_idx", "value"))


_KIND_OF = """kind_of AS (SELECT *, CASE WHEN length(value) > 70 THEN 'UNKNOWN' WHEN regexp_full_match(value, '[0-9]+') AND CAST(value AS BIGINT) BETWEEN 1000 AND 2022 THEN 'DATE' WHEN regexp_full_match(value, '[0-9]+([.][0-9]+)?') THEN 'CARDINAL'
  WHEN regexp_full_match(value, '[0-9]+%') THEN 'PERCENT' WHEN value = 'yes' THEN 'BOOLEAN' ELSE 'UNKNOWN' END AS label FROM sheet)"""
_SHARES = f"""WITH {_SHEET}, {_KIND_OF}, named AS (SELECT table_id, col_idx, CASE WHEN col_idx = 0 AND label = 'CARDINAL' THEN 'ORDINAL' ELSE label END AS label FROM kind_of),
shares AS (SELECT table_id, col_idx, label, count(*) / CAST(sum(count(*)) OVER (PARTITION BY table_id, col_idx) AS DOUBLE) AS score FROM named GROUP BY table_id, col_idx, label)"""


@query(f"{_SHARES} SELECT table_id, col_idx, label, round(score, 6) AS score FROM shares")
def settled_types(spark: SparkSession, sf: str) -> DataFrame:
    """Types of columns whose cells may have several: years are numbers too, counts are ordinals."""
    t = _sheet(spark, sf)
    return columns.column_types(t, typing.type_values(t), "labels", 9, header=False).select("table_id", "col_idx", "label", F.round("score", 6).alias("score"))


@query(f"""{_SHARES}, looks AS (SELECT table_id, col_idx, avg(CASE WHEN length(value) > 150 THEN 1 ELSE 0 END) AS long_, avg(CASE WHEN len(list_distinct(regexp_extract_all(value, '[[:punct:]]'))) > 3 THEN 1 ELSE 0 END) AS signs FROM sheet GROUP BY ALL),
sums AS (SELECT table_id, col_idx, coalesce(sum(score) FILTER (label = 'UNKNOWN'), 0) AS e, coalesce(sum(score) FILTER (label = 'PERCENT'), 0) AS u, coalesce(sum(score) FILTER (label IN ('CARDINAL', 'ORDINAL')), 0) AS p, arg_max(label, score) AS top, max(score) AS best FROM shares GROUP BY ALL)
SELECT table_id, col_idx, CASE WHEN e > 0.5 AND long_ < 0.5 AND signs < 0.5 THEN 'entity' WHEN top = 'DATE' AND best > 0.5 THEN 'date' WHEN top = 'DATE' THEN NULL WHEN col_idx = 0 AND top = 'ORDINAL' THEN 'index' WHEN u > 0.5 THEN 'with_unit' WHEN p > 0.5 THEN 'without_unit' ELSE 'text' END AS kind FROM sums JOIN looks USING (table_id, col_idx)""")
def column_kinds(spark: SparkSession, sf: str) -> DataFrame:
    t = _sheet(spark, sf)
    return annotate.classify_columns(t, columns.column_types(t, typing.type_values(t), "labels", 9, header=False))


# --- literal context

_LITERALS = """cust AS (SELECT 'C' || c_custkey AS entity, c_custkey AS k, c_mktsegment AS seg, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS cents, c_acctbal < 0 AS minus FROM customer),
ords AS (SELECT 'O' || o_orderkey AS entity, o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)"""


@query(f"""WITH {_LITERALS}
SELECT 'c' AS table_id, CAST(k AS INT) AS row_idx, 0 AS col_idx, entity, 1 AS ctx_col, lower(seg) AS mention, 'P452' AS pid, 'text' AS kind, 1.0::DOUBLE AS match FROM cust
UNION ALL SELECT 'c', CAST(k AS INT), 0, entity, 2, '$' || (cents // 100 + 1), 'P2284', 'with_unit', round(1 - (cents // 100 + 1 - cents / 100.0) / (cents // 100 + 1 + cents / 100.0 + 1e-4), 6) FROM cust WHERE NOT minus AND 1 - (cents // 100 + 1 - cents / 100.0) / (cents // 100 + 1 + cents / 100.0 + 1e-4) > 0.75
UNION ALL SELECT 'o', CAST(k AS INT), 0, entity, 1, CASE WHEN k % 3 = 0 THEN substr(day, 1, 4) WHEN k % 3 = 1 THEN day ELSE substr(day, 1, 4) || '-02-31' END, 'P585', 'date', CASE WHEN k % 3 < 2 THEN 1.0 ELSE 0.8 END FROM ords""")
def literal_context(spark: SparkSession, sf: str) -> DataFrame:
    """Literals of the graph that fit cells of a row: segments in other letters, balances in whole dollars, dates in part."""
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders")
    ent, key, day = views.named("C", "c_custkey"), F.col("c_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    dollars = F.concat(F.lit("$"), (F.floor(F.round(F.abs("c_acctbal") * 100).cast("bigint") / 100) + 1).cast("bigint").cast("string"))
    one = c.select(F.lit("c").alias("table_id"), key.cast("int").alias("row_idx"), F.posexplode(F.array(ent, F.lower("c_mktsegment"), dollars)).alias("col_idx", "value"))
    k = F.col("o_orderkey")
    part = F.when(k % 3 == 0, F.substring(day, 1, 4)).when(k % 3 == 1, day).otherwise(F.concat(F.substring(day, 1, 4), F.lit("-02-31")))
    two = o.select(F.lit("o").alias("table_id"), k.cast("int").alias("row_idx"), F.posexplode(F.array(views.named("O", "o_orderkey"), part)).alias("col_idx", "value"))
    t = one.unionByName(two)
    kinds = spark.createDataFrame([("c", 0, "entity"), ("c", 1, "text"), ("c", 2, "with_unit"), ("o", 0, "entity"), ("o", 1, "date")], "table_id string, col_idx int, kind string")
    cand = t.where("col_idx = 0").select("table_id", "row_idx", "col_idx", F.col("value").alias("entity"))
    found = annotate.literal_matches(cand, t, kinds, views.edges(spark, sf), views.units(spark))
    return found.drop("ord").withColumn("match", F.round("match", 6))


# --- graph


@query("SELECT DISTINCT 'N' || n_nationkey AS entity, n_name AS label FROM nation UNION SELECT 'R' || r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE 'No English Label' END FROM region UNION SELECT 'none', ''")
def entity_labels(spark: SparkSession, sf: str) -> DataFrame:
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    empty = F.array().cast("array<string>")
    nodes = n.select(views.named("N", "n_nationkey").alias("entity"), F.array("n_name", F.lit("other")).alias("labels")).unionByName(r.select(views.named("R", "r_regionkey").alias("entity"), F.when(F.col("r_regionkey") % 2 == 0, F.array("r_name")).otherwise(empty).alias("labels")))
    asked = nodes.select("entity").unionByName(spark.range(1).select(F.lit("none").alias("entity")))
    return graph.label_of(asked, nodes)


@query("SELECT 'U' || n_nationkey AS entity, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE substr(n_name, 1, 2) END AS symbol FROM nation")
def unit_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """A currency's label, else the unit's first symbol."""
    n = read(spark, sf, "nation")
    ent = views.named("U", "n_nationkey")
    row = lambda pid, obj, ord_: n.select(ent.alias("subject"), F.lit(pid).alias("pid"), F.lit(False).alias("backward"), obj.alias("object"), F.lit("NORMAL").alias("tag"), F.lit(ord_).alias("ord"), F.col("n_nationkey").alias("k"))
    edges = row(INSTANCE_OF, F.lit(CURRENCY_CLASS), 0).where("k % 2 = 0").unionByName(row(UNIT_SYMBOL, F.substring("n_name", 1, 2), 1)).unionByName(row(UNIT_SYMBOL, F.lit("zz"), 2)).drop("k")
    nodes = n.select(ent.alias("entity"), F.array("n_name").alias("labels"))
    return graph.unit_symbols(nodes, edges, nodes, UNIT_SYMBOL, INSTANCE_OF, CURRENCY_CLASS)


@query(f"WITH {edges_sql()} SELECT subject, pid, object FROM edges WHERE pid NOT LIKE '%P131%' AND subject NOT LIKE 'P%' AND object NOT LIKE 'P%'")
def without_property(spark: SparkSession, sf: str) -> DataFrame:
    e = graph.signed(graph.without_property(views.edges(spark, sf), "P131"))
    return e.where("subject not like 'P%' and object not like 'P%'").select("subject", "pid", "object")


@query(f"WITH {edges_sql()}, names(p, n) AS (VALUES ('P361', 'part of'), ('P131', 'located in')), paths AS (SELECT DISTINCT pid AS a FROM edges) SELECT x.a || '::' || y.a AS path, "
       "CASE WHEN x.a LIKE '(-)%' THEN '(-)' ELSE '' END || coalesce(m.n, replace(x.a, '(-)', '')) || '::' || CASE WHEN y.a LIKE '(-)%' THEN '(-)' ELSE '' END || coalesce(o.n, replace(y.a, '(-)', '')) AS written "
       "FROM paths x, paths y LEFT JOIN names m ON m.p = replace(x.a, '(-)', '') LEFT JOIN names o ON o.p = replace(y.a, '(-)', '')")  # fmt: skip
def path_names(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of two hops with their properties' names."""
    pids = graph.signed(views.edges(spark, sf)).select("pid").distinct()
    names = F.create_map(F.lit("P361"), F.lit("part of"), F.lit("P131"), F.lit("located in"))
    # the properties of the graph are few
    two = pids.select(F.col("pid").alias("a")).crossJoin(F.broadcast(pids.select(F.col("pid").alias("b")))).select(F.concat_ws("::", "a", "b").alias("path"))
    return two.select("path", graph.rewrite(F.col("path"), names).alias("written"))


@query(f"WITH {edges_sql()} SELECT subject, pid, object, tag FROM edges WHERE subject IN ('N1', 'N2', 'R0')")
def graph_point_read(spark: SparkSession, sf: str) -> DataFrame:
    """The graph written by subject buckets, and the edges of three entities out of it."""
    path = f"{folder(spark)}/graph-{uuid.uuid4().hex}"
    sinks.write_graph(views.edges(spark, sf), path)
    found = sinks.point_read(spark.read.parquet(path), ["N1", "N2", "R0"])
    return graph.signed(found).select("subject", "pid", "object", "tag")


@query(f"WITH {edges_sql()} SELECT subject, pid, object, tag FROM edges WHERE regexp_matches(subject, '^[NRT]') AND pid NOT IN ('(-)P131', '(-)P31')")
def graph_dump(spark: SparkSession, sf: str) -> DataFrame:
    """The graph of regions, nations and types as JSON lines with trailing commas, read back as edges."""
    e = graph.signed(views.edges(spark, sf)).where("subject rlike '^[NRT]' and pid not in ('(-)P131', '(-)P31')")
    props = e.groupBy("subject", "pid").agg(F.map_from_entries(F.collect_list(F.struct("object", "tag"))).alias("m"))
    lines = props.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("pid", "m"))).alias("p"))
    path = f"{folder(spark)}/dump-{uuid.uuid4().hex}"
    lines.select(F.concat(F.to_json(F.create_map("subject", "p")), F.lit(",")).alias("value")).write.option("compression", "gzip").text(path)
    edges, _ = readers.read_graph_dump(spark, path)
    return edges.select("subject", "pid", "object", "tag")


# --- index


@query(f"WITH {twins.hits_sql('{mentions}')} SELECT mention, entity, label, origin, round(bm25, 5) AS bm25 FROM hits QUALIFY row_number() OVER (PARTITION BY mention ORDER BY round(bm25, 9) DESC, entity, label, origin) <= 7".replace("{mentions}", words_of(S_CELLS)))
def lookup_capped(spark: SparkSession, sf: str) -> DataFrame:
    """The best seven hits of each mention: the cap of raw hits at work."""
    t = views.supplier_cells(spark, sf).where("row_idx > 0 and col_idx < 3")
    mentions = t.select(normalise_label(F.col("value")).alias("mention")).distinct()
    index = lookup.label_documents(views.label_dump(spark, sf))
    return lookup.hits(mentions, index, LookupConfig(max_hits=7)).select("mention", "entity", "label", "origin", F.round("bm25", 5).alias("bm25"))


@query(twins.LOOKUP.replace("{mentions}", words_of(S_CELLS)).replace("SELECT mention, entity, label, origin, round(ratio, 6) AS ratio, partial, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 20", "SELECT round(avg(n), 2) AS average FROM (SELECT mention, count(*) AS n FROM ranked GROUP BY mention)"))
def average_candidates(spark: SparkSession, sf: str) -> DataFrame:
    t = views.supplier_cells(spark, sf).where("row_idx > 0 and col_idx < 3")
    return lookup.average_candidates(lookup.candidate_counts(t.select(F.col("value").alias("mention")), stored(lookup.label_documents(views.label_dump(spark, sf)), "index")))


@query("SELECT label, CASE WHEN trim(label) = '' THEN 'empty label' END AS error, EXISTS (SELECT 1 FROM region WHERE lower(r_name) = lower(label)) AS answered FROM (SELECT r_name AS label FROM region UNION ALL SELECT * FROM (VALUES (''), ('  '), ('zzzzzzzzzzzzzzzzzz')) v(label))")
def lookup_response(spark: SparkSession, sf: str) -> DataFrame:
    """One row a label, as a service answers: entities, or an error."""
    r = read(spark, sf, "region").select(F.col("r_name").alias("mention"))
    asked = r.unionByName(spark.createDataFrame([("",), ("  ",), ("zzzzzzzzzzzzzzzzzz",)], "mention string"))
    out = lookup.response(lookup.lookup(asked, lookup.label_documents(views.label_dump(spark, sf))), asked)
    return out.select("label", "error", F.col("entities").isNotNull().alias("answered"))


# --- sources and sinks


@query("SELECT 'g' || n_regionkey AS table_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS row_idx, CAST(c AS INT) AS col_idx, [n_name, CAST(n_nationkey AS VARCHAR)][c + 1] AS value FROM nation, range(2) r(c) WHERE true".replace("FROM nation, range(2) r(c) WHERE true", "FROM (SELECT * FROM nation) n2, range(2) r(c)").replace("row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)", "row_number() OVER (PARTITION BY n_regionkey, c ORDER BY n_nationkey)"))
def tables_in_memory(spark: SparkSession, sf: str) -> DataFrame:
    """Whole tables as arrays of arrays, to cells and back and again."""
    n = read(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    data = F.transform("x", lambda r: F.array(r["n_name"], r["n_nationkey"].cast("string")))
    once = cells.to_cells(n.select(F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("table_id"), data.alias("data")))
    return cells.to_cells(cells.to_rows(once))


_FILE = "SELECT CAST(row_number() OVER (PARTITION BY c ORDER BY n_nationkey) - 1 AS INT) AS row_idx, CAST(c AS INT) AS col_idx, [CAST(n_nationkey AS VARCHAR), n_name, 'a,b ' || n_regionkey][c + 1] AS value FROM nation, range(3) r(c)"


def _written(spark: SparkSession, sf: str, name: str) -> str:
    """One delimited text file of the nations."""
    n = read(spark, sf, "nation")
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit(";"), "n_name", F.lit(';"a,b '), F.col("n_regionkey").cast("string"), F.lit('"'))
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    n.orderBy("n_nationkey").coalesce(1).select(line.alias("value")).write.text(path)
    return path


@query(_FILE)
def text_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A text file of unknown form, read by its extension."""
    return readers.read_tables(spark, _written(spark, sf, "files")).select("row_idx", "col_idx", "value")


@query(_FILE)
def delimited_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The same file when its form is known."""
    return readers.read_delimited(spark, _written(spark, sf, "known"), ";").select("row_idx", "col_idx", "value")


@query("SELECT 'N' || n_nationkey AS id, CAST(n_regionkey AS DOUBLE) AS page_rank, n_name || '|' || lower(n_name) AS labels FROM nation")
def label_dump(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as gzipped JSON lines with trailing commas."""
    n = read(spark, sf, "nation")
    row = F.struct(views.named("N", "n_nationkey").alias("ID"), F.col("n_regionkey").cast("double").alias("page_rank"), F.array("n_name", F.lower("n_name")).alias("labels"))
    path = f"{folder(spark)}/labels-{uuid.uuid4().hex}"
    n.select(F.concat(F.to_json(row), F.lit(",")).alias("value")).write.option("compression", "gzip").text(path)
    return readers.read_label_dump(spark, path).select(F.col("ID").alias("id"), "page_rank", F.array_join("labels", "|").alias("labels"))


@query(f"WITH {views.INDEX_SQL} SELECT entity, label, origin, pr FROM index_")
def index_sink(spark: SparkSession, sf: str) -> DataFrame:
    """The label index written by entity bucket; a second write leaves it as it is."""
    path = f"{folder(spark)}/index-{uuid.uuid4().hex}"
    index = lookup.label_documents(views.label_dump(spark, sf))
    sinks.write_index(index, path)
    sinks.write_index(index.limit(0), path)
    return spark.read.parquet(path).select("entity", "label", "origin", "pr")


@query("SELECT 'g' || n_regionkey AS table_id, '[' || string_agg('{\"k\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS json FROM nation GROUP BY n_regionkey")
def tables_json(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation").select(F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("table_id"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return sinks.table_json(n)


@query("SELECT * FROM (VALUES ('dollar', 'dollar', 1.0::DOUBLE), ('metre', 'metre', 1.0), ('kilometre', 'metre', 1000.0), ('second', 'second', 1.0), ('hour', 'second', 3600.0), ('kilogram', 'kilogram', 1.0), ('gram', 'kilogram', 0.001), ('metre per second', 'metre per second', 1.0)) u(name, base_unit, factor)")
def unit_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{folder(spark)}/units-{uuid.uuid4().hex}"
    views.units(spark).write.json(path)
    return readers.read_units(spark, path).select("name", "base_unit", "factor")
