"""Reading files as tables, by extension, and looking at what was read."""

from __future__ import annotations

import functools
import urllib.parse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.functions import semantics as S
from gridmill.functions.semantics import col
from gridmill.sources import sniff, workbooks

PREVIEW_ROWS = 10_000
# File extensions by reader.
EXTENSIONS = {
    "csv": "csv", "txt": "csv", "dat": "csv", "tsv": "tsv", "tab": "tsv", "json": "json", "parquet": "parquet", "pq": "parquet",
    "xml": "xml", "xlsx": "workbook", "xlsm": "workbook",
}
UNSUPPORTED = ("xls", "xlsb", "ods")
_SPARK_CHARSET = {"utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE"}
_CORRUPT = "__corrupt"


class ReadError(ValueError):
    """A path that no reader understands."""


def extension_of(spark: SparkSession, path: str) -> str:
    """Extension of a file or glob; for a folder, of one file inside it."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in name and name.rsplit(".", 1)[-1].lower() in (*EXTENSIONS, *UNSUPPORTED):
        return name.rsplit(".", 1)[-1].lower()
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").limit(1)
    found = listing.first()
    inner = found[0].rsplit("/", 1)[-1] if found else name
    return inner.rsplit(".", 1)[-1].lower() if "." in inner else ""


def read_table(
    spark: SparkSession, path: str, fmt: str | None = None, schema: str | T.StructType | None = None, **options
) -> DataFrame:
    """Read any supported file, folder or glob; an unknown extension is tried as
    delimited text."""
    ext = fmt or extension_of(spark, path)
    if ext in UNSUPPORTED:
        raise ReadError(f".{ext} files are not supported")
    kind = EXTENSIONS.get(ext, "csv")
    if kind == "parquet":
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if kind == "json":
        return read_json(spark, path, schema=schema, **options)
    if kind == "xml":
        return read_xml(spark, path, options.get("row_tag", "row"), schema)
    if kind == "workbook":
        return workbooks.read_workbook_table(spark, path, **options)
    if kind == "tsv":
        options.setdefault("sep", "\t")
    return read_delimited(spark, path, schema=schema, **options)


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    encoding: str | None = None,
    schema: str | T.StructType | None = None,
    multiline: bool = False,
    keep_rejected: bool = False,
) -> DataFrame:
    """Header row, inferred types; rows with too many fields are left out, rows
    with too few are padded with nulls.

    Without ``sep`` or ``encoding`` every file is looked at as a whole. Files of
    one format are read together, and formats are put together by column name.

    ``multiline`` allows line breaks inside quotes, at the price of one task per
    file. ``keep_rejected`` keeps the long rows, marked in ``_rejected``.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if sep is not None and encoding is not None:
        return _read_one_format(spark, path, sep, encoding, schema, multiline, keep_rejected)
    formats = sniff.sniff_encoding(spark, path) if encoding is None else sniff.files_of(spark, path).withColumn("encoding", F.lit(encoding))
    if sep is None:
        found = sniff.sniff_delimiter(spark, path).select(F.col("file").alias("_f"), "delimiter")
        formats = formats.join(found, F.col("file") == F.col("_f"), "left")
    else:
        formats = formats.withColumn("delimiter", F.lit(sep))
    # lines of two-byte text cannot be cut at a separator before decoding
    delimiter = F.when(F.col("encoding").startswith("utf-16"), F.lit(sep or ",")).otherwise(F.coalesce("delimiter", F.lit(",")))
    groups = _files_by(formats.select("file", delimiter.alias("sep"), "encoding"), path, "sep", "encoding")
    parts = [
        _read_one_format(spark, files, k["sep"], k["encoding"], schema, multiline, keep_rejected)
        for k, files in groups or [({"sep": sep or ",", "encoding": encoding or "utf-8"}, path)]
    ]
    return _put_together(parts)


def _files_by(formats: DataFrame, path: str, *keys: str) -> list[tuple[dict, str | list[str]]]:
    """The files of each format; ``path`` itself where all files have one."""
    kinds = formats.select(*keys).distinct().orderBy(*keys).collect()
    if len(kinds) == 1:
        return [(kinds[0].asDict(), path)]
    out = []
    for kind in kinds:
        same = functools.reduce(lambda a, b: a & b, [F.col(k) == F.lit(kind[k]) for k in keys])
        names = [r[0] for r in formats.filter(same).select("file").orderBy("file").collect()]
        out.append((kind.asDict(), [urllib.parse.unquote(n) for n in names]))
    return out


def _put_together(parts: list[DataFrame]) -> DataFrame:
    """Union by name; a column of several types becomes double if all are numbers, else text."""
    kinds: dict[str, set] = {}
    for part in parts:
        for f in part.schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType)
    mixed = {n: "double" if all(map(S.is_numeric_type, k)) else "string" for n, k in kinds.items() if len(k) > 1}
    same = [p.withColumns({n: col(n).cast(t) for n, t in mixed.items() if n in p.columns}) for p in parts]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), same)


def _read_one_format(
    spark: SparkSession, path: str | list[str], sep: str, encoding: str, schema: T.StructType | None, multiline: bool, keep_rejected: bool
) -> DataFrame:
    if encoding.startswith("utf-16"):
        multiline = True
    # single-byte pages are read as Latin-1, which keeps every byte, and put right below
    page = encoding if encoding in sniff.CODE_PAGES and encoding != "latin-1" else None
    charset = "ISO-8859-1" if page else _SPARK_CHARSET.get(encoding, encoding)
    base = spark.read.option("header", "true").option("sep", sep).option("encoding", charset).option("multiLine", str(multiline).lower())
    base = base.option("escape", '"')
    if schema is None:
        schema = base.option("inferSchema", "true").csv(path).schema
    names = schema.fieldNames()
    wide = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    rows = (
        base.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
        .option("enforceSchema", "true").option("columnPruning", "false").csv(path)
    )
    bare = F.regexp_replace(F.coalesce(col(_CORRUPT), F.lit("")), '"[^"]*"', "")
    too_long = F.size(F.split(bare, f"\\Q{sep}\\E", -1)) > len(names)
    # the reader wants a data column next to the corrupt-record column
    anchored = too_long | (F.coalesce(F.length(col(names[0]).cast("string")), F.lit(0)) < 0)
    text = {f.name for f in schema.fields if isinstance(f.dataType, T.StringType)} if page else set()
    clean = [(sniff.decoded(col(n), page) if n in text else col(n)).alias(sniff.decoded_name(n, page) if page else n) for n in names]
    out = rows.withColumn("_rejected", anchored)
    # the words NaN and Infinity are missing values in a table of text
    if keep_rejected:
        return S.fold_missing(out.select(*clean, "_rejected"))
    return S.fold_missing(out.filter(~F.col("_rejected")).select(*clean))


def rejected_rows(spark: SparkSession, path: str, **options) -> DataFrame:
    """One row (kept, rejected): what ``read_delimited`` takes and leaves."""
    rows = read_delimited(spark, path, keep_rejected=True, **options)
    return rows.agg(
        F.count(F.when(~F.col("_rejected"), 1)).alias("kept"), F.count(F.when(F.col("_rejected"), 1)).alias("rejected")
    )


# --- JSON -------------------------------------------------------------------

def read_json(spark: SparkSession, path: str, orient: str | None = None, schema=None) -> DataFrame:
    """JSON as a list of records, or laid out as split, index, columns, values.

    Each file is one document. Without ``orient`` the layout is read off each
    document; a plain object of objects counts as ``index``. Files of different
    layouts are put together by column name.
    """
    if orient is None:
        groups = _files_by(_json_layouts(spark, path), path, "layout")
        return _put_together([_read_layout(spark, files, k["layout"], schema) for k, files in groups or [({"layout": "records"}, path)]])
    return _read_layout(spark, path, orient, schema)


def _read_layout(spark: SparkSession, path: str | list[str], orient: str, schema) -> DataFrame:
    if orient == "records":
        reader = spark.read.option("multiLine", "true")
        return (reader.schema(schema) if schema else reader).json(path)
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    if orient == "index":
        cells = docs.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("idx", "row"))
        names = _key_names(cells.select(F.explode(F.map_keys("row")).alias("k")), docs, "index")
        return sniff.typed(cells.select(*[F.col("row")[n].alias(n) for n in names]))
    if orient == "columns":
        cells = docs.select("file", F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("name", "values"))
        tall = cells.select("file", "name", F.explode("values").alias("idx", "v"))
        names = [r[0] for r in cells.select("name").distinct().orderBy("name").collect()]
        return sniff.typed(tall.groupBy("file", "idx").pivot("name", names).agg(F.first("v", True)).select(*map(col, names)))
    if orient == "split":
        doc = docs.select("file", F.from_json("value", "struct<columns:array<string>,data:array<array<string>>>").alias("d"))
        met = doc.select("file", F.posexplode("d.columns").alias("at", "name"))
        first = met.groupBy("name").agg(F.min(F.struct("file", "at")).alias("first")).orderBy("first")
        names = [r[0] for r in first.select("name").collect()]
        rows = doc.select(F.col("d.columns").alias("c"), F.explode("d.data").alias("r"))
        value = lambda n: F.when(F.array_contains("c", n), F.get("r", (F.array_position("c", n) - 1).cast("int")))
        return sniff.typed(rows.select(*[value(n).alias(n) for n in names]))
    if orient == "values":
        rows = docs.select(F.explode(F.from_json("value", "array<array<string>>")).alias("r"))
        width = rows.agg(F.max(F.size("r"))).first()[0] or 0
        return sniff.typed(rows.select(*[F.get("r", F.lit(i)).alias(str(i)) for i in range(width)]))
    raise ReadError(f"unknown JSON layout {orient!r}")


def _key_names(keys: DataFrame, docs: DataFrame, layout: str) -> list[str]:
    names = [r[0] for r in keys.distinct().orderBy("k").collect()]
    if not names:
        raise ReadError(f"no columns in the {layout} document")
    return names


def _json_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(file, layout) from the beginning and the keys of each document."""
    value, keys = F.col("value"), F.json_object_keys("value")
    starts = lambda pattern: F.regexp_like(value, F.lit(r"^\s*" + pattern))
    layout = (
        F.when(starts(r"\[\s*\["), "values")
        .when(starts(r"\["), "records")
        .when(F.array_contains(keys, "columns") & F.array_contains(keys, "data"), "split")
        .when(starts(r'\{\s*"[^"]*"\s*:\s*\{'), "index")
        .otherwise("records")
    )
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), layout.alias("layout"))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema=None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


# --- looking at a table -----------------------------------------------------

def extract_preview(df: DataFrame, n: int = PREVIEW_ROWS, *order) -> DataFrame:
    """The first ``n`` rows (in the stated order) with lower-case names."""
    head = df.orderBy(*order).limit(n) if order else df.limit(n)
    return S.fold_missing(normalize_columns(head, "lower"))


def row_count(df: DataFrame) -> DataFrame:
    """One row (total_rows); Parquet answers from its footers."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def normalize_columns(df: DataFrame, style: str = "strip") -> DataFrame:
    """Strip names; ``lower`` also lower-cases and replaces spaces by ``_``.
    Equal names get a numbered suffix."""
    names, seen = [], {}
    for c in df.columns:
        n = c.strip()
        if style == "lower":
            n = n.replace(" ", "_").lower()
        seen[n] = seen.get(n, 0) + 1
        while seen[n] > 1 and f"{n}_{seen[n]}" in df.columns:
            seen[n] += 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names)
