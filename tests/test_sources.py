"""Readers and writers on hand-written files."""

import io
import json
import zipfile

import pytest
from conftest import rows

from gridmill.functions import semantics as S
from gridmill.queries.sources import workbook_bytes
from gridmill.sources import databases, sinks, sniff, tables, workbooks


def test_loads_a_small_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n3,4\n")
    df = tables.read_table(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["a", "b"] and rows(df) == [(1, 2), (3, 4)]


def test_long_rows_go_short_rows_stay(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c\n1,x,2\n3,"y,z"\n4,w,5,6\n7,"q,r",8\n')
    df = tables.read_table(spark, str(tmp_path / "t.csv"))
    assert rows(df) == [(1, "x", 2), (3, "y,z", None), (7, "q,r", 8)]
    assert tuple(tables.rejected_rows(spark, str(tmp_path / "t.csv")).first()) == (3, 1)
    assert df.count() == 3 and df.select("b").count() == 3


@pytest.mark.parametrize("sep", [",", ";", "\t", "|", ":"])
def test_delimiters(spark, tmp_path, sep):
    lines = [sep.join(("name", "n", "note"))] + [sep.join((f'"a{sep}b"', str(i), "x, y; z" if sep in "|\t:" else "x")) for i in range(20)]
    (tmp_path / "t.txt").write_text("\n".join(lines) + "\n")
    got = sniff.sniff_delimiter(spark, str(tmp_path / "t.txt")).first()
    assert (got["delimiter"], got["fields"]) == (sep, 3)


@pytest.mark.parametrize(
    "codec,name",
    [("utf-8", "utf-8"), ("utf-8-sig", "utf-8"), ("latin-1", "latin-1"), ("cp1252", "cp1252"), ("utf-16", "utf-16"),
     ("utf-16-le", "utf-16-le"), ("utf-16-be", "utf-16-be"), ("ascii", "utf-8")],
)
def test_encodings(spark, tmp_path, codec, name):
    text = {"cp1252": "naïve “quotes”", "ascii": "plain"}.get(codec, "café déjà")
    (tmp_path / "t.csv").write_bytes(f"k,v\n1,{text}\n2,{text}\n".encode(codec))
    path = str(tmp_path / "t.csv")
    assert sniff.sniff_encoding(spark, path).first()["encoding"] == name
    df = tables.read_table(spark, path)
    assert df.columns == ["k", "v"]
    assert {r[1] for r in df.collect()} == {text}


def test_line_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"two\nlines"\n2,x\n')
    df = tables.read_delimited(spark, str(tmp_path / "t.csv"), multiline=True)
    assert tables.row_count(df).first()[0] == 2


@pytest.mark.parametrize("orient", ["records", "split", "index", "columns", "values"])
def test_json_layouts(spark, tmp_path, orient):
    data = {
        "records": [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}],
        "split": {"columns": ["a", "b"], "index": [0, 1], "data": [[1, "x"], [2, "y"]]},
        "index": {"0": {"a": 1, "b": "x"}, "1": {"a": 2, "b": "y"}},
        "columns": {"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": "y"}},
        "values": [[1, "x"], [2, "y"]],
    }[orient]
    (tmp_path / "t.json").write_text(json.dumps(data))
    df = tables.read_json(spark, str(tmp_path / "t.json"), orient if orient == "columns" else None)
    assert rows(df) == [(1, "x"), (2, "y")]


def test_xml_records(spark, tmp_path):
    (tmp_path / "t.xml").write_text("<t><r><a>1</a><b>x</b></r><r><a>2</a></r></t>")
    assert rows(tables.read_table(spark, str(tmp_path / "t.xml"), row_tag="r")) == [(1, "x"), (2, None)]


def test_workbook_folder(spark, tmp_path):
    (tmp_path / "one.xlsx").write_bytes(workbook_bytes([["a", "b"], [1, "x"], [2.5, "y"]]))
    (tmp_path / "two.xlsx").write_bytes(workbook_bytes([["b", "a", "c"], ["z", 3, 9]]))
    df = tables.read_table(spark, str(tmp_path))
    assert df.columns == ["a", "b", "c"]
    assert rows(df) == [(1.0, "x", None), (2.5, "y", None), (3.0, "z", 9)]
    assert tables.read_table(spark, str(tmp_path / "two.xlsx"), sheet="data").count() == 1


def test_workbook_shared_strings_and_gaps():
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = io.BytesIO(workbook_bytes([["x"]]))
    parts = {n: zipfile.ZipFile(out).read(n) for n in zipfile.ZipFile(out).namelist()}
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{main}"><si><t>he</t></si><si><r><t>l</t></r><r><t>lo</t></r></si></sst>'
    parts["xl/worksheets/sheet1.xml"] = (
        f'<worksheet xmlns="{main}"><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="AA2"><v>4</v></c></row></sheetData></worksheet>'
    )
    again = io.BytesIO()
    with zipfile.ZipFile(again, "w") as z:
        for n, body in parts.items():
            z.writestr(n, body)
    ((sheet, number, cells),) = workbooks.parse_workbook(again.getvalue())
    assert (sheet, number, cells[1], cells[26], len(cells)) == ("data", 2, "llo", "4", 27)


def test_names_are_normalised_with_suffixes(spark):
    df = spark.range(1).selectExpr("id AS ` A b`", "id AS `a B`", "id AS `c `")
    assert tables.normalize_columns(df, "lower").columns == ["a_b", "a_b_2", "c"]
    assert tables.normalize_columns(df).columns == ["A b", "a B", "c"]


def test_unknown_and_unsupported_extensions(spark, tmp_path):
    (tmp_path / "t.xls").write_bytes(b"x")
    with pytest.raises(tables.ReadError):
        tables.read_table(spark, str(tmp_path / "t.xls"))
    (tmp_path / "t.log").write_text("a;b\n1;2\n")
    assert rows(tables.read_table(spark, str(tmp_path / "t.log"))) == [(1, 2)]


def test_saving_never_replaces(spark, tmp_path):
    df = S.small_frame(spark, [(1, "a,b"), (2, 'q"r')], "n int, t string")
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        sinks.save_table(df, path, fmt)
        assert rows(tables.read_table(spark, path)) == [(1, "a,b"), (2, 'q"r')]
        with pytest.raises(Exception, match="(?i)exist"):
            sinks.save_table(df, path, fmt)


def test_database_modes():
    assert databases.MODES == {"replace": "overwrite", "append": "append", "fail": "errorifexists"}
    with pytest.raises(ValueError):
        databases.load_jdbc(None, "jdbc:x", "t", "sometimes")


def test_a_folder_of_mixed_separators_and_encodings(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "two.csv").write_text("b;a\né;3\nz;4\n", encoding="latin-1")
    df = tables.read_table(spark, str(tmp_path / "*.csv"))
    assert rows(df.select("a", "b")) == [(1, "x"), (2, "y"), (3, "é"), (4, "z")]


def test_json_columns_of_two_files_with_the_same_index(spark, tmp_path):
    for i in (0, 1):
        (tmp_path / f"{i}.json").write_text(json.dumps({"a": {"0": 10 * i, "1": 10 * i + 1}, "b": {"0": "x", "1": "y"}}))
    df = tables.read_json(spark, str(tmp_path), orient="columns")
    assert rows(df.select("a", "b")) == [(0, "x"), (1, "y"), (10, "x"), (11, "y")]


def test_json_split_with_two_column_orders(spark, tmp_path):
    (tmp_path / "0.json").write_text(json.dumps({"columns": ["a", "b"], "data": [[1, "x"]]}))
    (tmp_path / "1.json").write_text(json.dumps({"columns": ["b", "a"], "data": [["y", 2], ["z"]]}))
    df = tables.read_json(spark, str(tmp_path))
    assert df.columns == ["a", "b"] and sorted(map(str, rows(df))) == ["(1, 'x')", "(2, 'y')", "(None, 'z')"]


def test_json_files_of_two_layouts(spark, tmp_path):
    (tmp_path / "0.json").write_text(json.dumps([{"a": 1, "b": "x"}]))
    (tmp_path / "1.json").write_text(json.dumps({"columns": ["a", "b"], "data": [[2, "y"]]}))
    assert rows(tables.read_json(spark, str(tmp_path)).select("a", "b")) == [(1, "x"), (2, "y")]


def test_short_words_are_not_boolean(spark):
    df = spark.createDataFrame([("y", "1", "True"), ("n", "y", "false")], "a string, b string, c string")
    assert [t for _, t in sniff.typed(df).dtypes] == ["string", "string", "boolean"]


def test_the_first_sheet_of_a_book_is_the_default(spark, tmp_path):
    book = zipfile.ZipFile(io.BytesIO(workbook_bytes([["x"], [1]])))
    parts = {n: book.read(n) for n in book.namelist()}
    parts["xl/workbook.xml"] = parts["xl/workbook.xml"].replace(b"</sheets>", b'<sheet name="a" r:id="r2"/></sheets>')
    parts["xl/_rels/workbook.xml.rels"] = parts["xl/_rels/workbook.xml.rels"].replace(b"</Rel", b'<Relationship Id="r2" Target="worksheets/sheet2.xml"/></Rel')
    parts["xl/worksheets/sheet2.xml"] = parts["xl/worksheets/sheet1.xml"].replace(b"<v>1</v>", b"<v>2</v>")
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        for n, body in parts.items():
            z.writestr(n, body)
    assert rows(workbooks.read_workbook_table(spark, str(tmp_path / "b.xlsx"))) == [(1,)]
    assert rows(workbooks.read_workbook_table(spark, str(tmp_path / "b.xlsx"), "a")) == [(2,)]


@pytest.mark.parametrize("page, text", [
    ("cp1250", "Zażółć gęślą jaźń, příliš žluťoučký kůň"), ("mac_roman", "Où est l’été, garçon? Über die Straße, señor"),
    ("cp437", "Où est été, garçon? Über die Straße, señor"), ("cp1252", "Où est l’été, “garçon”? Über die Straße"), ("latin-1", "Où est été, garçon? Über die Straße"),
])
def test_code_pages_are_told_and_read_back(spark, tmp_path, page, text):
    words = text.split()
    rows = [f"{i},{words[i % len(words)]} {words[(i * 7 + 1) % len(words)]}".replace(",", ";", 1) for i in range(300)]
    path = tmp_path / "file.csv"
    path.write_bytes("\n".join(["id;texté" if page != "cp1250" else "id;zażółć", *rows]).encode(page))
    assert sniff.sniff_encoding(spark, str(path)).first()["encoding"] == page
    got = tables.read_table(spark, str(path))
    assert got.columns[1] in ("texté", "zażółć")
    assert sorted(f"{r[0]};{r[1]}" for r in got.collect()) == sorted(rows)


def test_words_for_no_number_are_missing(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("a,b\n1.5,x\nNaN,y\nInfinity,z\n")
    assert [r.a for r in tables.read_table(spark, str(path)).orderBy("b").collect()] == [1.5, None, None]
