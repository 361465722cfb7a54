import gzip
import io
import json
import zipfile

from pyspark.sql import functions as F

from gridsense.operators.cells import to_rows
from gridsense.sources import readers, shared, sinks
from gridsense.streaming.tables import each_batch

SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData>{}</worksheet>'


def workbook(rows, merged=""):
    body = "".join(f'<row r="{r}">' + "".join(f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' for ref, v in cells) + "</row>" for r, cells in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", SHEET.format(body, merged))
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name; land\nCafé Zoé à la carte; \"x;y\"\n".encode("latin-1"))
    (tmp_path / "b.tsv").write_bytes(b"\xef\xbb\xbfp\tq\n1\t2\n")
    (tmp_path / "c.xlsx").write_bytes(workbook([(1, [("A1", "h"), ("B1", "i")]), (2, [("A2", "1"), ("B2", "2")]), (4, [("A4", "u")]), (5, [("A5", "v")])], '<mergeCells><mergeCell ref="A5:B5"/></mergeCells>'))
    (tmp_path / "d.bin").write_bytes(b"\0")
    (tmp_path / "e.xlsx").write_bytes(b"broken")
    got = {r.table_id.rsplit("/", 1)[-1]: r.data for r in to_rows(readers.read_tables(spark, str(tmp_path))).collect()}
    assert got == {"a.csv": [["name", "land"], ["Café Zoé à la carte", "x;y"]], "b.tsv": [["p", "q"], ["1", "2"]], "c.xlsx#0.0": [["h", "i"], ["1", "2"]], "c.xlsx#0.1": [["u"], ["v", "v"]]}


def test_dates_and_colours_of_sheets():
    x = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    styles = f'<styleSheet {x}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.00&quot;d&quot;"/></numFmts><fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"/></fill></fills><borders><border/><border><left style="thin"/></border></borders><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="0" fillId="1"/><xf numFmtId="0" borderId="1"/></cellXfs></styleSheet>'
    cells = [("A1", 1, "43831"), ("B1", 2, "43831.5"), ("A2", 3, "2.5"), ("B2", 0, "43831"), ("C1", 4, None), ("C2", 5, None), ("D1", 0, None)]
    body = "".join(f'<c r="{r}" s="{s}">' + (f"<v>{v}</v>" if v else "") + "</c>" for r, s, v in cells)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {x}><sheetData><row>{body}</row></sheetData></worksheet>")
        z.writestr("xl/styles.xml", styles)
    assert readers.parse_workbook(out.getvalue()) == [{(0, 0): "01/01/2020", (0, 1): "01/01/2020", (1, 0): "2.5", (1, 1): "43831"}]
    assert readers.region_tables(readers.parse_workbook(out.getvalue(), True)[0]) == [[["01/01/2020", "01/01/2020", ""], ["2.5", "43831", ""]]]


def test_regions():
    grid = {(0, 0): "a", (0, 1): "b", (1, 0): "c", (5, 5): "lone", (8, 2): "x", (8, 3): "y", (9, 3): "z"}
    assert readers.region_tables(grid) == [[["a", "b"], ["c", ""]], [["x", "y"], ["", "z"]]]


def test_known_form(spark, tmp_path):
    (tmp_path / "k.csv").write_text("a, b\n1, 2\n")
    assert [r.data for r in to_rows(readers.read_delimited(spark, str(tmp_path / "k.csv"))).collect()] == [[["a", "b"], ["1", "2"]]]


def test_dumps(spark, tmp_path):
    with gzip.open(tmp_path / "labels.json.gz", "wt") as f:
        f.write('[\n{"ID": "Q1", "page_rank": 2, "labels": ["a"], "main_aliases": ["b"]},\nnot json\n]')
    assert [tuple(r)[:3] for r in readers.read_label_dump(spark, str(tmp_path / "labels.json.gz")).collect()] == [("Q1", 2.0, ["a"])]
    line = {"Q1": {"labels": {"en-us": ["one"], "fr": ["un"]}, "P31": {"Q5": "NORMAL"}, "P569": {"1901-00-00": "DateTime-Year"}, "P1889": {"Q7": "NORMAL"}, "(-)P27": ["Q8", "Q9"]}}
    with gzip.open(tmp_path / "graph.json.gz", "wt") as f:
        f.write(json.dumps(line) + ",\n")
    edges, nodes = readers.read_graph_dump(spark, str(tmp_path / "graph.json.gz"))
    assert sorted((r.pid, r.object, r.tag, r.backward) for r in edges.collect()) == [("(-)P27", "Q8", "NORMAL", True), ("(-)P27", "Q9", "NORMAL", True), ("P31", "Q5", "NORMAL", False), ("P569", "1901", "DateTime-Year", False)]
    assert [tuple(r) for r in nodes.collect()] == [("Q1", ["one"], [], [], 4)]
    path = str(tmp_path / "graph")
    sinks.write_graph(edges, path)
    sinks.write_graph(edges.limit(0), path)
    assert sinks.point_read(spark.read.parquet(path), ["Q1"]).count() == 4 and sinks.point_read(spark.read.parquet(path), ["Q2"]).count() == 0


def test_json_rollup(spark):
    df = spark.createDataFrame([("t", 1, "b"), ("t", 0, "a")], "table_id string, row_idx int, value string")
    assert json.loads(sinks.table_json(df).first().json) == [{"row_idx": 0, "value": "a"}, {"row_idx": 1, "value": "b"}]


def test_stream(spark, tmp_path):
    rows = [(f"t{k}", [["a", "b"], [str(k), ""]]) for k in range(6)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, "table_id string, data array<array<string>>").repartition(3).write.parquet(src)
    stream = spark.readStream.schema("table_id string, data array<array<string>>").option("maxFilesPerTrigger", 1).parquet(src)
    for _ in range(2):
        each_batch(stream, lambda c: c.groupBy("table_id").agg(F.count("*").alias("n")), out, str(tmp_path / "ck")).awaitTermination(60)
    assert sorted((r.table_id, r.n) for r in spark.read.parquet(out).collect()) == [(f"t{k}", 4) for k in range(6)]


def test_scratch_tables(spark):
    df = shared.table(spark.range(5), "x")
    assert df.count() == 5 and shared.folder(spark) in df._scratch_path
    shared.drop(df)
