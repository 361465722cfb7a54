"""Primitive typing of cell strings: numbers, ranges, addresses, booleans, phones, units, and a gazetteer.

Every parser is a Column expression that gives an array of labels; `type_values` runs all of them once for each
distinct value and joins what they found. Entity recognition is a plug-in: any function of (values) -> (value, labels),
by default a gazetteer table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CONCEPTS
from .values import string_type

# a small grammar of numbers: digits and a decimal part after a point or comma; a sign; a vulgar fraction
NUMBER = r"\d+(?:[.,]\d*)?"
SIGNED = rf"[+-]?{NUMBER}"
FRACTION = r"[+-]?\d*[⅐-⅞¼-¾]"
SHARE = rf"(?:{NUMBER}|[.]\d+)\s*%"
# an interval: two numbers parted by dashes, in brackets or not, or by commas, with a bracket at one end at least
OPENS, CLOSES = r"(?:\s*[\[{(])", r"(?:\s*[\])}])"
DASHED, LISTED = rf"\s*{NUMBER}\s*[-–]+\s*{NUMBER}", rf"\s*{NUMBER}\s*,+\s*{NUMBER}"
INTERVAL = "|".join([f"{OPENS}*{DASHED}{CLOSES}*", f"{OPENS}+{LISTED}{CLOSES}*", f"{OPENS}*{LISTED}{CLOSES}+"])
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d|0\d{1,2})"
_HEX = r"[0-9a-f]{1,4}"

#: label -> pattern that must match a whole value
PATTERNS = {
    "RANGE": rf"(?U)(?:{INTERVAL})\s*",
    "CARDINAL": rf"(?U)\s*(?:{SIGNED}|{FRACTION})\s*",
    "PERCENT": rf"(?U)\s*{SHARE}\s*",
    "IP ADDRESS": rf"{_OCTET}(?:\.{_OCTET}){{3}}",
    "IPv6 ADDRESS": rf"(?i)\s*(?=[0-9a-f:]*:)(?!.*::.*::)(?!.*:::)(?:(?:{_HEX}:){{7}}{_HEX}|(?=.*::)(?:{_HEX})?(?::{{1,2}}{_HEX}){{0,7}}(?:::)?)\s*",
    "BOOLEAN": r"(?i)\s*(?:true|false|on|off|yes|no)\s*",
}
#: Fixed values of the international numbering plan: length of a national number by country code, where it is known;
#: codes of two digits, and beginnings of codes of three digits, that are assigned. Other national numbers have 6 to 12
#: digits, and no number has over 15.
PHONES = {
    "1": (10, 10), "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (6, 11), "40": (9, 9), "41": (9, 9), "43": (7, 13), "44": (9, 10), "45": (8, 8),
    "46": (7, 10), "47": (8, 8), "48": (9, 9), "49": (6, 11), "52": (10, 10), "54": (10, 11), "55": (10, 11), "60": (8, 10), "61": (9, 9), "62": (8, 12), "63": (8, 10), "64": (8, 10), "65": (8, 8), "66": (8, 9), "81": (9, 10), "82": (8, 10),
    "84": (9, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10), "92": (9, 10), "98": (10, 10), "351": (9, 9), "352": (6, 11), "353": (7, 9), "358": (6, 12), "380": (9, 9), "420": (9, 9), "852": (8, 8), "886": (8, 9), "966": (8, 9), "971": (8, 9), "972": (8, 9),
}
OTHER_CODES = "51|53|56|57|58|93|94|95|2[1-69][0-9]|3[578][0-9]|42[1-9]|50[0-9]|59[0-9]|6[7-9][0-9]|85[0-9]|88[0-9]|96[0-9]|97[0-9]|99[0-9]"
MOST = 70  # longer values are not typed


def _full(c: Column, pattern: str) -> Column:
    return c.rlike(r"\A(?:" + pattern + r")\z" if not pattern.startswith("(?") or pattern[2] not in "Ui" else pattern[:4] + r"\A(?:" + pattern[4:] + r")\z")


def _some(pairs: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*[F.when(test, F.lit(label)) for test, label in pairs]), lambda x: x.isNotNull())


def pattern_labels(c: Column) -> Column:
    year = c.rlike(r"\A\s*[+-]?[0-9]+\s*\z") & F.trim(c).try_cast("bigint").between(1000, 2022)
    return _some([(F.coalesce(year, F.lit(False)), "DATE"), *((_full(c, p), label) for label, p in PATTERNS.items())])


def phone_labels(c: Column) -> Column:
    bare = F.regexp_replace(c, r"[\s().-]", "")
    known = "|".join(rf"{code}[1-9]\d{{{lo - 1},{hi - 1}}}" for code, (lo, hi) in PHONES.items())
    other = rf"(?!(?:{'|'.join(PHONES)})\d*$)(?:{OTHER_CODES})[1-9]\d{{5,11}}"
    return _some([(bare.rlike(rf"^\+(?=\d{{7,15}}$)(?:{known}|{other})$") & c.rlike(r"^\s*\+"), "PHONE NUMBER")])


def typable(c: Column) -> Column:
    """Not '', not one sign repeated, not a lone character that is no ASCII letter or digit."""
    return (c != "") & ~c.rlike(r"\A(\p{Punct})\1*\z") & ~((F.length(c) == 1) & ~c.rlike("[0-9A-Za-z]"))


def is_concept(label: Column) -> Column:
    """By substring, so that SURFACE TENSION counts too."""
    test = F.lit(False)
    for x in CONCEPTS:
        test = test | label.contains(x)
    return test


def unit_labels(values: DataFrame, units: DataFrame) -> DataFrame:
    """(value, labels): values that are numbers with units cover most of. `units` is a small dimension table."""
    found = values.select("value", F.explode(F.regexp_extract_all("value", F.lit(r"([+-]?\d[\d,]*\.?\d*\s*[\p{L}°$€£¥%/²³]+|[$€£¥]\s*\d[\d,]*\.?\d*)"), 1)).alias("surface"))
    found = found.withColumn("unit", F.lower(F.trim(F.regexp_replace("surface", r"[\d,.+\-\s]", ""))))
    known = found.join(F.broadcast(units.select(F.lower("symbol").alias("unit"), "dimension").distinct()), "unit")
    label = F.when(F.col("dimension") == "time", "DURATION").when(F.col("dimension") == "length", "DISTANCE").when(F.col("dimension") == "currency", "MONEY").otherwise(F.upper("dimension"))
    bare = F.length(F.replace("value", F.lit(" "), F.lit("")))
    grouped = known.groupBy("value").agg(F.sum(F.length(F.replace("surface", F.lit(" "), F.lit("")))).alias("covered"), F.array_sort(F.collect_set(label)).alias("labels"))
    return grouped.where(1.4 * F.col("covered") >= bare).select("value", "labels")


def gazetteer(names: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A recogniser from a table (name, label)."""

    def run(values: DataFrame) -> DataFrame:
        by = names.select(F.lower("name").alias("name"), "label")
        return values.join(by, F.lower("value") == F.col("name")).groupBy("value").agg(F.array_sort(F.collect_set("label")).alias("labels"))

    return run


def type_values(values: DataFrame, units: DataFrame | None = None, recogniser: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`typing` of the distinct `value`s: phone, pattern, unit and entity labels in that order, else UNKNOWN."""
    distinct = values.select("value").where(typable(F.col("value"))).distinct()
    out = distinct.withColumn("labels", F.concat(phone_labels(F.col("value")), pattern_labels(F.col("value"))))
    short = distinct.where(F.length("value") <= MOST)
    for more in [unit_labels(short, units) if units is not None else None, recogniser(short) if recogniser else None]:
        if more is not None:
            out = out.join(more.withColumnRenamed("labels", "more"), "value", "left").select("value", F.concat("labels", F.coalesce("more", F.array().cast("array<string>"))).alias("labels"))
    concept = F.exists("labels", is_concept)
    plain = F.filter("labels", lambda x: ~x.isin("CARDINAL", "ORDINAL", "DATE"))
    labels = F.array_distinct(F.when(concept, plain).otherwise(F.col("labels")))
    unknown = F.array(F.lit("UNKNOWN"))
    labels = F.when((F.length("value") > MOST) | (F.size(labels) == 0), unknown).otherwise(labels)
    typed = out.select("value", labels.alias("labels"))
    kinds = F.array_distinct(F.transform("labels", lambda x: F.when(is_concept(x), string_type(F.col("value"))).otherwise(x)))
    return typed.withColumn("dtypes", kinds)
