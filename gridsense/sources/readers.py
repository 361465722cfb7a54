"""Readers of table files and dumps. All give `cells` or graph tables, many files in one job."""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import clean_date
from ..model import CELLS, DIFFERENT_FROM

DELIMITERS = ",\t;:"


def decode(raw: bytes) -> str:
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, errors="replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        if len(raw) < 2000:  # too little for statistics: the most common single-byte encoding
            try:
                return raw.decode("cp1252")
            except UnicodeDecodeError:
                return raw.decode("latin-1")
        try:
            from charset_normalizer import from_bytes

            best = from_bytes(raw).best()
            return str(best) if best is not None else raw.decode("latin-1")
        except ImportError:
            return raw.decode("latin-1")


def parse_text(raw: bytes) -> list[list[str]]:
    """Rows of a delimited text of unknown encoding and delimiter; [] if it cannot be parsed."""
    text = decode(raw)
    try:
        dialect = csv.Sniffer().sniff(text[:65536], DELIMITERS)
    except csv.Error:
        dialect = csv.excel
    dialect.skipinitialspace = True
    try:
        return list(csv.reader(io.StringIO(text), dialect))
    except csv.Error:
        return []


_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


# Fixed values of the file format: number formats built in that show a day
_DAYS = {*range(14, 18), 22, *range(27, 32), *range(34, 37), *range(50, 59)}


def _styles(raw: bytes | None) -> list[tuple[bool, bool]]:
    """(shows a day, is filled or has a border at its left or right) of each cell format of a workbook."""
    if raw is None:
        return []
    root = ET.fromstring(raw)
    day = set(_DAYS)
    for x in root.iter(_X + "numFmt"):
        bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", x.get("formatCode", "")).lower()
        if "d" in bare or "y" in bare:
            day.add(int(x.get("numFmtId", "-1")))
    children = lambda name: list(root.find(_X + name) if root.find(_X + name) is not None else [])
    fills = [any(p.get("patternType", "none") != "none" for p in x.iter(_X + "patternFill")) for x in children("fills")]
    edges = [any((e := x.find(_X + side)) is not None and e.get("style", "none") != "none" for side in ("left", "right")) for x in children("borders")]
    at = lambda flags, k: 0 <= k < len(flags) and flags[k]
    return [(int(x.get("numFmtId", "0")) in day, at(fills, int(x.get("fillId", "-1"))) or at(edges, int(x.get("borderId", "-1")))) for x in children("cellXfs")]


def _day(serial: str, first: datetime) -> str:
    """The day of a serial number, as text; the number itself if it is none."""
    try:
        return (first + timedelta(days=float(serial))).strftime("%m/%d/%Y")
    except (ValueError, OverflowError):
        return serial


def parse_workbook(raw: bytes, styled: bool = False) -> list[dict[tuple[int, int], str]]:
    """The filled cells of each sheet of an .xlsx file; merged ranges hold their first cell's value throughout, dates
    are texts. With `styled`, empty cells with a colour or a border at a side count as filled with ''."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(_X + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        styles = _styles(z.read("xl/styles.xml") if "xl/styles.xml" in names else None)
        late = "xl/workbook.xml" in names and any(x.get("date1904") in ("1", "true") for x in ET.fromstring(z.read("xl/workbook.xml")).iter(_X + "workbookPr"))
        first = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
        out = []
        for name in sorted(n for n in names if n.startswith("xl/worksheets/sheet")):
            root, grid = ET.fromstring(z.read(name)), {}
            for c in root.iter(_X + "c"):
                ref = c.get("r", "A1")
                v = c.find(_X + "v")
                text = "".join(t.text or "" for t in c.iter(_X + "t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                style = int(c.get("s", "-1"))
                day, seen = styles[style] if 0 <= style < len(styles) else (False, False)
                if c.get("t") == "s" and text:
                    text = shared[int(text)]
                elif day and text and c.get("t", "n") == "n":
                    text = _day(text, first)
                if text != "" or (styled and seen):
                    grid[int("".join(filter(str.isdigit, ref))) - 1, _column(ref)] = text
            for m in root.iter(_X + "mergeCell"):
                a, _, b = m.get("ref", "A1").partition(":")
                r0, c0 = int("".join(filter(str.isdigit, a))) - 1, _column(a)
                r1, c1 = int("".join(filter(str.isdigit, b or a))) - 1, _column(b or a)
                if (r0, c0) in grid:
                    for r in range(r0, r1 + 1):
                        for c in range(c0, c1 + 1):
                            grid[r, c] = grid[r0, c0]
            out.append(grid)
        return out


def blank_line_tables(grid: dict[tuple[int, int], str]) -> list[list[list[str]]]:
    """Tables of a sheet that blank rows part."""
    rows: dict[int, dict[int, str]] = {}
    for (r, c), v in grid.items():
        rows.setdefault(r, {})[c] = v
    out: list[list[list[str]]] = []
    last = None
    for r in sorted(rows):
        if last is None or r > last + 1:
            out.append([])
        out[-1].append([rows[r].get(c, "") for c in range(max(rows[r]) + 1)])
        last = r
    return out


def region_tables(grid: dict[tuple[int, int], str]) -> list[list[list[str]]]:
    """Tables of a sheet that are connected regions of filled cells, as their bounding boxes of over one row and column."""
    left = set(grid)
    boxes = []
    while left:
        stack, member = [min(left)], []
        left.discard(stack[0])
        while stack:
            r, c = stack.pop()
            member.append((r, c))
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.discard(n)
                    stack.append(n)
        r0, r1 = min(r for r, _ in member), max(r for r, _ in member)
        c0, c1 = min(c for _, c in member), max(c for _, c in member)
        if r1 > r0 and c1 > c0:
            boxes.append((r0, c0, r1, c1))
    return [[[grid.get((r, c), "") for c in range(c0, c1 + 1)] for r in range(r0, r1 + 1)] for r0, c0, r1, c1 in sorted(boxes)]


def parse_file(path: str, raw: bytes, split: str = "blank") -> list[tuple[str, list[list[str]]]]:
    """(table id, rows) of a file by its extension; nothing for an unknown or broken one."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv", "txt"):
        rows = parse_text(raw)
        return [(path, rows)] if rows else []
    if kind == "xlsx":
        try:
            sheets = parse_workbook(raw, split == "region")
        except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, IndexError):
            return []
        cut = region_tables if split == "region" else blank_line_tables
        return [(f"{path}#{s}.{k}", t) for s, g in enumerate(sheets) for k, t in enumerate(cut(g))]
    return []


def read_tables(spark: SparkSession, path: str, split: str = "blank") -> DataFrame:
    """`cells` of all csv, tsv, txt and xlsx files under `path`; files are read by Spark, each in one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(t, r, c, v) for p, raw in zip(frame["path"], frame["content"], strict=True) for t, data in parse_file(p, bytes(raw), split) for r, line in enumerate(data) for c, v in enumerate(line)]
            yield pd.DataFrame(rows, columns=["table_id", "row_idx", "col_idx", "value"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, CELLS)


def read_delimited(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """`cells` of delimited files of known form, by Spark's reader: no header, all strings, leading blanks dropped. Row
    numbers are those of the file, which must fit a task (multiLine)."""
    raw = spark.read.csv(path, sep=sep, encoding=encoding, ignoreLeadingWhiteSpace=True, header=False, multiLine=True)
    named = raw.select(F.input_file_name().alias("table_id"), F.monotonically_increasing_id().alias("i"), F.array(*[F.coalesce(c, F.lit("")) for c in raw.columns]).alias("v"))
    from pyspark.sql import Window

    numbered = named.withColumn("row_idx", F.row_number().over(Window.partitionBy("table_id").orderBy("i")) - 1)
    return numbered.select("table_id", "row_idx", F.posexplode("v").alias("col_idx", "value"))


def read_label_dump(spark: SparkSession, path: str) -> DataFrame:
    """(ID, page_rank, labels, main_aliases, sub_aliases) of (gzipped) JSON lines with trailing commas; others are dropped."""
    schema = "ID string, page_rank double, labels array<string>, main_aliases array<string>, sub_aliases array<string>"
    return spark.read.text(path).select(F.from_json(F.regexp_replace("value", r",\s*$", ""), schema).alias("x")).select("x.*").where("ID is not null")


def read_graph_dump(spark: SparkSession, path: str, language: str = "en-us") -> tuple[DataFrame, DataFrame]:
    """(kg_edges, kg_nodes) of (gzipped) JSON lines {entity: {pid: {object: tag}}} with trailing commas.

    The property "different from" is dropped, dates lose empty parts, and pids that begin with (-) are backward."""
    text = F.regexp_replace(F.trim("value"), r",\s*$", "")
    lines = spark.read.text(path).select(F.explode(F.from_json(text, "map<string, map<string, string>>")).alias("entity", "props"))
    props = lines.select("entity", F.posexplode("props").alias("k", "pid", "raw"))
    named = ["labels", "aliases", "descriptions"]
    facts = props.where(~F.col("pid").isin(named) & ~F.col("pid").contains(DIFFERENT_FROM)).select("entity", "k", "pid", F.posexplode(F.from_json("raw", "map<string, string>")).alias("i", "object", "tag"))
    # a backward value may be a list of objects
    listed = props.where(~F.col("pid").isin(named) & F.col("raw").startswith("[")).select("entity", "k", "pid", F.posexplode(F.from_json("raw", "array<string>")).alias("i", "object")).withColumn("tag", F.lit("NORMAL"))
    every = facts.unionByName(listed)
    obj = F.when(F.col("tag").startswith("DateTime"), clean_date(F.col("object"))).otherwise(F.col("object"))
    edges = every.select(F.col("entity").alias("subject"), "pid", F.col("pid").startswith("(-)").alias("backward"), obj.alias("object"), "tag", (F.col("k") * 1_000_000 + F.col("i")).cast("int").alias("ord"))
    texts = props.where(F.col("pid").isin(named)).groupBy("entity").pivot("pid", named).agg(F.first(F.try_element_at(F.from_json("raw", "map<string, array<string>>"), F.lit(language))))
    count = edges.groupBy(F.col("subject").alias("entity")).agg(F.count("*").alias("num_edges"))
    nodes = lines.select("entity").distinct().join(texts, "entity", "left").join(count, "entity", "left")
    empty = F.array().cast("array<string>")
    return edges, nodes.select("entity", *(F.coalesce(c, empty).alias(c) for c in named), F.coalesce("num_edges", F.lit(0)).alias("num_edges"))


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """The unit dimension (name, symbol, dimension, base_unit, factor); an absent file is an error here, not later."""
    return spark.read.schema("name string, symbol string, dimension string, base_unit string, factor double").json(path)
