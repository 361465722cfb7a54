"""Scalar functions of cell values: string kinds, numbers, dates, quantities, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_type(c: Column) -> Column:
    digits = F.length(F.regexp_replace(c, r"[^0-9]", ""))
    return F.when(F.length(c) >= 100, "String_Normal").when(2 * digits >= F.length(c), "String_Number").when(F.upper(c) == c, "String_Uppercase").otherwise("String_Normal")


def punctuation_kinds(c: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\p{Punct})"), 1)))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, " "), lambda w: w != ""))


def float_parse(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double")


def number_similarity(a: Column, b: Column) -> Column:
    return F.coalesce(1 - F.abs(a - b) / (F.abs(a) + F.abs(b) + 1e-4), F.lit(0.0))


def partial_date(c: Column) -> Column:
    """struct<y, m, d>: a date as far as it goes (y, y-m, y-m-d; also m/d/y); null fields where it stops."""
    iso = r"^\s*([+-]?\d{1,6})(?:-(\d{1,2}))?(?:-(\d{1,2}))?(?:[T ].*)?\s*$"
    us = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*$"
    part = lambda p, k: F.regexp_extract(c, p, k).try_cast("int")
    return F.struct(F.coalesce(part(iso, 1), part(us, 3)).alias("y"), F.coalesce(part(iso, 2), part(us, 1)).alias("m"), F.coalesce(part(iso, 3), part(us, 2)).alias("d"))


def date_score(a: Column, b: Column) -> Column:
    """1 if equal as far as both go, at least to the year; 0.8 in one year; else 0."""
    x, y = partial_date(a), partial_date(b)
    same = lambda k: x[k].isNull() | y[k].isNull() | (x[k] == y[k])
    return F.when(x["y"].isNull() | y["y"].isNull() | (x["y"] != y["y"]), 0.0).when(same("m") & same("d"), 1.0).otherwise(0.8)


def period_score(period: Column, a: Column) -> Column:
    """1 if a period value `start:end` and a cell of two dates (parted by a dash, 'to' or a colon) agree at both ends."""
    p = F.split(period, ":")
    q = F.split(F.regexp_replace(a, "[‐-―−]", "-"), r"\s+-\s+|\s+to\s+|:|(?<=\d{4})-(?=\d{4})")
    return F.when((F.size(p) == 2) & (F.size(q) == 2) & (date_score(p[0], q[0]) == 1.0) & (date_score(p[1], q[1]) == 1.0), 1.0).otherwise(0.0)


def popularity(edges: Column) -> Column:
    return F.when(F.coalesce(edges, F.lit(0)) > 0, 1 / (2 + F.log10(2 + edges))).otherwise(0.0)


def rank_weight(tag: Column) -> Column:
    """Of a statement: 2 if preferred, 1 if normal, else 0."""
    return F.when(tag == "PREFERRED", 2).when(tag == "NORMAL", 1).otherwise(0)


def sigmoid_weight(sim: Column) -> Column:
    return 1 / (1 + F.exp(-((F.pow(sim, F.lit(2.5)) / 0.5 - 1) / 0.2)))


def clean_date(c: Column) -> Column:
    """Dates of the graph without empty parts."""
    return F.regexp_replace(F.regexp_replace(c, "-00-00", ""), "-01-01", "")


def prefixed(entity: Column, base: str = "http://www.wikidata.org/entity/", prop: str = "http://www.wikidata.org/prop/direct/") -> Column:
    return F.when(entity.rlike("^Q[0-9]+$"), F.concat(F.lit(base), entity)).when(entity.rlike("^P[0-9]+$"), F.concat(F.lit(prop), entity)).otherwise(entity)


def is_id(c: Column) -> Column:
    return c.rlike("^[PQ][0-9]+$")


def flip(path: Column) -> Column:
    """A hop seen from its other end."""
    return F.when(path.startswith("(-)"), F.substring(path, 4, 1 << 30)).otherwise(F.concat(F.lit("(-)"), path))
