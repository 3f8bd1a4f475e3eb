"""Queries on readers and writers: tables written out and read back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from gridmill.functions import semantics as S
from gridmill.queries import register
from gridmill.queries import tables as t
from gridmill.queries.tables import load
from gridmill.session import scratch_path
from gridmill.sources import sinks, sniff, tables, workbooks


def _ntz(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@register("s01_read_csv", "SELECT * FROM orders")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.export_csv(load(spark, sf, "orders"), path)
    out = _ntz(tables.read_table(spark, path), "o_orderdate")
    return out.select(*[F.col(c).cast("bigint").alias(c) if c in ("o_orderkey", "o_custkey") else F.col(c) for c in out.columns])


@register("s02_read_tsv", "SELECT * FROM customer")
def _(spark, sf):
    path = scratch_path(spark, "tsv")
    load(spark, sf, "customer").write.option("header", "true").option("sep", "\t").csv(path)
    return tables.read_table(spark, path, "tsv", "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@register(
    "s03_sniff_delimiter",
    "SELECT * FROM (VALUES ('comma', ',', 6::INTEGER), ('semicolon', ';', 5::INTEGER), ('tab', chr(9), 4::INTEGER), ('pipe', '|', 6::INTEGER)) v(folder, delimiter, fields) "
    "WHERE (SELECT count(*) FROM orders) > 0",
)
def _(spark, sf):
    root = scratch_path(spark, "delimited")
    for folder, sep, name in (("comma", ",", "orders"), ("semicolon", ";", "customer"), ("tab", "\t", "supplier"), ("pipe", "|", "part")):
        load(spark, sf, name).write.option("header", "true").option("sep", sep).csv(f"{root}/{folder}")
    found = sniff.sniff_delimiter(spark, f"{root}/*/*.csv")
    return found.select(F.regexp_extract("file", "/([a-z]+)/[^/]+$", 1).alias("folder"), "delimiter", "fields").distinct()


@register(
    "s04_sniff_encoding",
    "SELECT * FROM (VALUES ('plain', 'utf-8'), ('latin', 'latin-1'), ('wide', 'utf-16-le'), ('accents', 'utf-8'), ('mac', 'mac_roman'), ('dos', 'cp437'), ('central', 'cp1250')) v(folder, encoding) "
    "WHERE (SELECT count(*) FROM conversations) > 0",
)
def _(spark, sf):
    root = scratch_path(spark, "encoded")
    text = F.regexp_replace(F.regexp_replace("text", "[\\r\\n]+", " "), "[^ -~à-ÿ]", "")
    c = load(spark, sf, "conversations").select("conv_id", text.alias("text"))
    accents = c.filter(F.regexp_like("text", F.lit("[àâçèéêëîïôùûüäöñáíóúß]")))  # without one, a file is plain ASCII in any page
    load(spark, sf, "orders").write.csv(f"{root}/plain")
    c.write.csv(f"{root}/accents")
    accents.write.option("encoding", "ISO-8859-1").csv(f"{root}/latin")
    # these pages are written as the Latin-1 text that has their bytes
    for folder, page in (("mac", "mac_roman"), ("dos", "cp437")):
        accents.select("conv_id", _as_latin("text", page)).write.option("encoding", "ISO-8859-1").csv(f"{root}/{folder}")
    polish = accents.withColumn("text", F.translate(F.regexp_replace("text", "[à-ÿ]", ""), "aeszco", "ąęśżćó"))
    polish.select("conv_id", _as_latin("text", "cp1250")).write.option("encoding", "ISO-8859-1").csv(f"{root}/central")
    load(spark, sf, "supplier").write.option("encoding", "UTF-16LE").csv(f"{root}/wide")
    found = sniff.sniff_encoding(spark, f"{root}/*/*.csv")
    return found.select(F.regexp_extract("file", "/([a-z]+)/[^/]+$", 1).alias("folder"), "encoding").distinct()


def _as_latin(column: str, page: str):
    """Text whose Latin-1 bytes are those of ``column`` in ``page``; characters that the page lacks are left out."""
    high = bytes(range(128, 256))
    there = high.decode(page, "replace")
    known = "".join(c for c in there if c != "\ufffd")
    bare = F.regexp_replace(column, "[^\\x00-\\x7F" + known.replace("\xa0", "") + "]", "")
    pairs = [(c, chr(128 + i)) for i, c in enumerate(there) if c != "\ufffd"]
    return F.translate(bare, "".join(a for a, _ in pairs), "".join(b for _, b in pairs)).alias(column)


def _ragged(spark, sf) -> str:
    """Orders as lines: every tenth with a field too many, some with one too few."""
    path = scratch_path(spark, "ragged")
    full = F.concat_ws(",", "o_orderkey", "o_orderstatus", "o_totalprice")
    line = (
        F.when(F.col("o_orderkey") % 10 == 0, F.concat(full, F.lit(",extra")))
        .when(F.col("o_orderkey") % 10 == 1, F.concat_ws(",", "o_orderkey", "o_orderstatus"))
        .otherwise(full)
    )
    one = load(spark, sf, "orders").select(line.alias("o_orderkey,o_orderstatus,o_totalprice"))
    one.write.option("header", "true").option("sep", "\x01").option("quote", "").csv(path)
    return path


_RAGGED = "o_orderkey bigint, o_orderstatus string, o_totalprice double"


@register(
    "s05_bad_lines",
    "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 10 <> 1 THEN o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 0",
)
def _(spark, sf):
    return tables.read_table(spark, _ragged(spark, sf), "csv", _RAGGED)


@register(
    "s05_rejected_rows",
    "SELECT count(*) FILTER (WHERE o_orderkey % 10 <> 0) AS kept, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS rejected FROM orders",
)
def _(spark, sf):
    return tables.rejected_rows(spark, _ragged(spark, sf), schema=_RAGGED)


def _documents(spark, sf, name: str, layout) -> str:
    """A table as JSON documents of a bounded number of rows, one per file."""
    path = scratch_path(spark, "json")
    df = load(spark, sf, name)
    key = df.columns[0]
    part = F.floor(F.col(key) / 5_000).alias("part")
    docs = df.groupBy(part).agg(layout(df).alias("value"))
    docs.repartition(F.col("part")).write.partitionBy("part").text(path)
    return f"{path}/part=*/*.txt"


@register("s06_json_records", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, sf):
    rows = lambda df: F.to_json(F.collect_list(F.struct(*df.columns)))
    out = tables.read_json(spark, _documents(spark, sf, "orders", rows))
    return out.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


_JSON_SQL = "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier"


def _supplier(out):
    return out.select("s_suppkey", "s_name", "s_nationkey", F.col("s_acctbal").cast("double").alias("s_acctbal"))


@register("s07_json_split", _JSON_SQL)
def _(spark, sf):
    def layout(df):
        cells = F.collect_list(F.array(*[F.col(c).cast("string") for c in df.columns]))
        return F.to_json(F.struct(F.array(*[F.lit(c) for c in df.columns]).alias("columns"), cells.alias("data")))

    return _supplier(tables.read_json(spark, _documents(spark, sf, "supplier", layout)))


@register("s07_json_index", _JSON_SQL)
def _(spark, sf):
    def layout(df):
        row = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c).cast("string"))])
        return F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col(df.columns[0]).cast("string"), row))))

    return _supplier(tables.read_json(spark, _documents(spark, sf, "supplier", layout)))


@register("s07_json_columns", _JSON_SQL)
def _(spark, sf):
    def layout(df):
        key = F.col(df.columns[0]).cast("string")
        columns = [x for c in df.columns for x in (F.lit(c), F.map_from_entries(F.collect_list(F.struct(key, F.col(c).cast("string")))))]
        return F.to_json(F.create_map(*columns))

    return _supplier(tables.read_json(spark, _documents(spark, sf, "supplier", layout), "columns"))


@register("s07_json_values", _JSON_SQL)
def _(spark, sf):
    layout = lambda df: F.to_json(F.collect_list(F.array(*[F.col(c).cast("string") for c in df.columns])))
    out = tables.read_json(spark, _documents(spark, sf, "supplier", layout))
    return _supplier(out.toDF("s_suppkey", "s_name", "s_nationkey", "s_acctbal"))


@register("s08_read_parquet", "SELECT l_returnflag, sum(l_quantity) AS quantity FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def _(spark, sf):
    li = tables.read_table(spark, f"{sf}/lineitem.parquet")
    return li.filter("l_discount > 0.05").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity"))


@register("s09_read_xml", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def _(spark, sf):
    path = scratch_path(spark, "xml")
    load(spark, sf, "customer").write.format("xml").option("rowTag", "customer").option("rootTag", "customers").save(path)
    return tables.read_xml(spark, path, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


def workbook_bytes(rows: list[list]) -> bytes:
    """A minimal workbook with one sheet."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(v):
        return f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{v}</t></is></c>'

    body = "".join(f'<row r="{i + 1}">' + "".join(cell(v) for v in row) + "</row>" for i, row in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="data" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


@register("s10_read_workbooks", "SELECT s_acctbal, s_name, s_nationkey::BIGINT AS s_nationkey, s_suppkey FROM supplier")
def _(spark, sf):
    names = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]

    def book(pdf: pd.DataFrame) -> pd.DataFrame:
        # files list their columns in different orders
        order = names if int(pdf["part"].iloc[0]) % 2 else names[::-1]
        content = workbook_bytes([order, *pdf[order].to_numpy(dtype=object).tolist()])
        return pd.DataFrame({"path": [f"book-{pdf['part'].iloc[0]}.xlsx"], "content": [content]})

    parts = load(spark, sf, "supplier").withColumn("part", F.floor(F.col("s_suppkey") / 40))
    files = parts.groupBy("part").applyInPandas(book, "path string, content binary")
    out = workbooks.workbook_table(workbooks.workbook_rows(files), "data")
    return out.select("s_acctbal", "s_name", "s_nationkey", "s_suppkey")


@register("s11_dispatch", "SELECT 'parquet' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'csv', count(*) FROM customer UNION ALL SELECT 'json', count(*) FROM supplier")
def _(spark, sf):
    root = scratch_path(spark, "any")
    load(spark, sf, "customer").write.option("header", "true").csv(f"{root}/a")
    documents = _documents(spark, sf, "supplier", lambda df: F.to_json(F.collect_list(F.struct(*df.columns))))
    parts = [
        ("parquet", tables.read_table(spark, f"{sf}/orders.parquet")), ("csv", tables.read_table(spark, f"{root}/a")),
        ("json", tables.read_table(spark, documents, "json")),
    ]
    out = None
    for kind, df in parts:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@register("s12_preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10000")
def _(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias(" O_OrderKey "), F.col("o_totalprice").alias("O_TotalPrice"))
    return tables.extract_preview(o, 10_000, F.desc("O_TotalPrice"), F.asc("` O_OrderKey `"))


@register("s13_row_count", "SELECT count(*) AS total_rows FROM lineitem")
def _(spark, sf):
    return tables.row_count(load(spark, sf, "lineitem"))


@register("s14_normalize_columns", "SELECT c_custkey AS cust_key, c_name AS cust_name, c_mktsegment AS cust_name_2 FROM customer")
def _(spark, sf):
    c = load(spark, sf, "customer").select(
        F.col("c_custkey").alias(" Cust Key"), F.col("c_name").alias("Cust Name"), F.col("c_mktsegment").alias("cust_name ")
    )
    return tables.normalize_columns(c, "lower")


@register("k01_export_csv", "SELECT * FROM customer")
def _(spark, sf):
    path = scratch_path(spark, "out")
    df = load(spark, sf, "customer")
    sinks.export_csv(df, path)
    return spark.read.option("header", "true").schema(df.schema).csv(path)


@register(
    "k03_export_predictions",
    f"SELECT l_extendedprice::DOUBLE AS actual, round(sum(l_extendedprice) OVER (PARTITION BY l_quantity)::DOUBLE / count(*) OVER (PARTITION BY l_quantity), 4) AS predicted FROM ({t.LINEITEM})",
)
def _(spark, sf):
    from gridmill.ml.train import export_predictions
    from gridmill.queries.models import baseline

    path = scratch_path(spark, "predictions")
    export_predictions(baseline(spark, sf), "y", "yhat", path)
    out = spark.read.option("header", "true").schema("actual double, predicted double").csv(path)
    return out.withColumn("predicted", F.round("predicted", 4))


@register("k04_save_table", "SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_totalprice > 250000")
def _(spark, sf):
    path = scratch_path(spark, "saved")
    edited = load(spark, sf, "orders").filter("o_totalprice > 250000").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    sinks.save_table(edited, path)
    return spark.read.parquet(path)


@register("n02_scalar_json", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def _(spark, sf):
    return load(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
