"""Queries on column meaning, edits, cleaning and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.functions import semantics as S
from gridmill.operators import clean, profile, typing
from gridmill.queries import register
from gridmill.queries import tables as t
from gridmill.queries.tables import load, union_all

_LI = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag "
    "l_linestatus l_shipdate"
).split()
_ORD = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split()
_KIND = {"l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time"}


# --- typing -----------------------------------------------------------------

@register(
    "t01_column_kinds",
    " UNION ALL ".join(
        f"SELECT 'lineitem' AS dataset, {i}::INTEGER AS ordinal, '{c}' AS \"column\", '{_KIND.get(c, 'numeric')}' AS kind, "
        f"count({c}) AS non_null FROM ({t.LINEITEM_NULLS})"
        for i, c in enumerate(_LI)
    ),
)
def _(spark, sf):
    return typing.column_kinds(t.lineitem_nulls(spark, sf), "lineitem")


def _roles_sql(dataset: str, view: str, roles: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{dataset}' AS dataset, '{role}' AS role, '{c}' AS \"column\", count({c}) AS non_null FROM ({view})"
        for role, c in roles.items()
    )


@register(
    "t02_detect_roles",
    _roles_sql(
        "lineitem", t.LINEITEM_NULLS,
        {"value": "l_linenumber", "qty": "l_orderkey", "rate": "l_discount", "date": "l_extendedprice", "category": "l_linestatus"},
    ),
)
def _(spark, sf):
    return typing.roles_with_counts(t.lineitem_nulls(spark, sf), "lineitem")


@register(
    "t03_detect_kpi_roles",
    _roles_sql(
        "lineitem", t.LINEITEM_NULLS,
        {"value": "l_extendedprice", "qty": "l_linenumber", "date": "l_shipdate", "category": "l_returnflag"},
    ),
)
def _(spark, sf):
    return typing.roles_with_counts(t.lineitem_nulls(spark, sf), "lineitem", typing.kpi_roles_table)


def _events_text(spark, sf):
    """events with its time as text, some of it unreadable."""
    e = load(spark, sf, "events")
    text = F.when(F.col("event_id") % 4 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return e.select("event_id", text.alias("event_date"), F.year("ts").alias("event_year"), text.alias("note"), "event_type")


_SHARE = "(SELECT round(avg(CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE 1.0 END), 4) FROM events)"


@register(
    "t04_sniff_dates_name_sample",
    f"SELECT \"column\", CAST(s AS DOUBLE) AS parsed_share, s > 0.6 AS is_date FROM (VALUES ('event_id', 0.0), "
    f"('event_date', {_SHARE}), ('event_year', 0.0), ('note', 0.0), ('event_type', 0.0)) v(\"column\", s)",
)
def _(spark, sf):
    return typing.sniff_dates(_events_text(spark, sf), "name+sample")


@register(
    "t05_sniff_dates_sample",
    f"SELECT \"column\", CAST(s AS DOUBLE) AS parsed_share, s > 0.6 AS is_date FROM (VALUES ('event_id', 0.0), "
    f"('event_date', {_SHARE}), ('event_year', 0.0), ('note', {_SHARE}), ('event_type', 0.0)) v(\"column\", s)",
)
def _(spark, sf):
    return typing.sniff_dates(_events_text(spark, sf), "sample")


@register(
    "t06_sniff_dates_planner",
    f"SELECT \"column\", CAST(s AS DOUBLE) AS parsed_share, s > 0.5 AS is_date FROM (VALUES ('event_id', 0.0), "
    f"('event_date', {_SHARE}), ('event_year', 1.0), ('note', 0.0), ('event_type', 0.0)) v(\"column\", s)",
)
def _(spark, sf):
    return typing.sniff_dates(_events_text(spark, sf), "planner")


@register(
    "t07_sniff_text",
    union_all(
        "SELECT '{c}' AS \"column\", round(avg(length({c})), 4) AS mean_length, avg(length({c})) > 40 AS is_long_text FROM documents",
        ["text", "lang", "source"],
    ),
)
def _(spark, sf):
    return typing.sniff_text(load(spark, sf, "documents"))


_CARD = "CASE WHEN n_unique <= 10 THEN 'low' WHEN n_unique <= 50 THEN 'mid' ELSE 'high' END"


@register(
    "t08_cardinality",
    f"SELECT *, {_CARD} AS cardinality FROM ("
    + union_all("SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique FROM part", ["p_name", "p_brand", "p_type"])
    + ")",
)
def _(spark, sf):
    return typing.cardinality(load(spark, sf, "part"))


@register(
    "t09_domain_hints",
    "SELECT d AS dataset, h AS domain, n AS n_rows FROM (VALUES "
    "('lineitem', 'finance', (SELECT count(*) FROM lineitem)), ('lineitem', 'retail', (SELECT count(*) FROM lineitem)), "
    "('orders', 'finance', (SELECT count(*) FROM orders)), ('orders', 'retail', (SELECT count(*) FROM orders)), "
    "('part', 'finance', (SELECT count(*) FROM part))) v(d, h, n)",
)
def _(spark, sf):
    tables = {n: load(spark, sf, n) for n in ("lineitem", "orders", "part")}
    hints = typing.domain_hints(typing.column_catalog(spark, tables))
    sizes = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("dataset"), "n_rows")
        sizes = one if sizes is None else sizes.unionByName(one)
    return hints.join(sizes, "dataset")


@register(
    "t10_infer_task",
    """
    SELECT 'l_returnflag' AS target, 'classification' AS task, 'classification' AS problem_type, count(*) AS n_rows,
           count(l_returnflag) AS n_target, count(DISTINCT l_returnflag) AS n_unique FROM lineitem
    UNION ALL
    SELECT 'l_linenumber', CASE WHEN count(DISTINCT l_linenumber) <= 20 AND count(DISTINCT l_linenumber) / count(*) < 0.05
           THEN 'classification' ELSE 'regression' END, CASE WHEN count(DISTINCT l_linenumber) <= 20 AND
           count(DISTINCT l_linenumber) / count(*) < 0.05 THEN 'classification' ELSE 'regression' END, count(*),
           count(l_linenumber), count(DISTINCT l_linenumber) FROM lineitem
    UNION ALL
    SELECT 'l_extendedprice', 'regression', 'regression', count(*), count(l_extendedprice), count(DISTINCT l_extendedprice)
    FROM lineitem
    UNION ALL
    SELECT 'value', CASE WHEN count(DISTINCT ts) / count(*) > 0.5 THEN 'time_series' ELSE 'regression' END, 'regression',
           count(*), count(value), count(DISTINCT value) FROM events
    """,
)
def _(spark, sf):
    li, e = load(spark, sf, "lineitem"), load(spark, sf, "events")
    out = None
    for df, target, date in (
        (li, "l_returnflag", "l_shipdate"), (li, "l_linenumber", "l_shipdate"), (li, "l_extendedprice", "l_shipdate"),
        (e, "value", "ts"),
    ):
        one = typing.infer_task(df, target, date).select(F.lit(target).alias("target"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@register(
    "t11_detect_data_type",
    "SELECT 'tabular' AS data_type, 'classification' AS problem_type, count(*) AS n_rows, 6::INTEGER AS n_cols, "
    "count(DISTINCT o_orderstatus) AS n_classes, 'o_orderstatus' AS target_col FROM orders",
)
def _(spark, sf):
    return typing.detect_data_type(load(spark, sf, "orders"), "o_orderstatus", "o_orderdate")


# --- edits and cleaning -----------------------------------------------------

@register("p01_rename", "SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def _(spark, sf):
    return clean.edit(load(spark, sf, "orders"), "rename", "o_orderstatus", "status")


@register("p02_drop_column", "SELECT * EXCLUDE (o_orderpriority) FROM orders")
def _(spark, sf):
    return clean.edit(load(spark, sf, "orders"), "drop-col", "o_orderpriority")


@register(
    "p03_fill_missing",
    f"""
    WITH v AS ({t.LINEITEM_NULLS}), s AS (SELECT quantile_cont(l_quantity, 0.5) AS med, avg(l_quantity) AS mu FROM v),
    f AS (SELECT l_returnflag AS m FROM v WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT l_linestatus, coalesce(l_returnflag, (SELECT m FROM f)) AS l_returnflag,
           round(coalesce(l_quantity, (SELECT med FROM s)), 4) AS with_median,
           round(coalesce(l_quantity, (SELECT mu FROM s)), 4) AS with_mean,
           coalesce(l_quantity, 0) AS with_zero, coalesce(l_quantity, 99) AS with_literal, count(*) AS n
    FROM v GROUP BY ALL
    """,
)
def _(spark, sf):
    df = t.lineitem_nulls(spark, sf).select("l_linestatus", "l_returnflag", "l_quantity")
    df = clean.edit(df, "fill-missing", "l_returnflag", "mode")
    for name, how in (("with_median", "median"), ("with_mean", "mean"), ("with_zero", "0"), ("with_literal", "99")):
        df = clean.edit(df.withColumn(name, F.col("l_quantity")), "fill-missing", name, how)
    df = df.withColumns({c: F.round(c, 4) for c in ("with_median", "with_mean")}).drop("l_quantity")
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))


@register("p04_drop_duplicates", f"SELECT DISTINCT * FROM ({t.LINEITEM_DUPS})")
def _(spark, sf):
    return clean.edit(t.lineitem_dups(spark, sf), "drop-duplicates")


@register(
    "p05_sort",
    f"SELECT * FROM ({t.LINEITEM_NULLS}) ORDER BY l_quantity DESC NULLS LAST",
)
def _(spark, sf):
    return clean.edit(t.lineitem_nulls(spark, sf), "sort", "l_quantity", "desc")


@register("p06_filter_rows", "SELECT * FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'O')")
def _(spark, sf):
    kept = clean.edit(load(spark, sf, "orders"), "filter-rows", "o_totalprice", "> 100000")
    return clean.edit(kept, "filter-rows", "o_orderstatus", "in ['F', 'O']")


@register(
    "p07_safe_head",
    "SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE value END AS value FROM events "
    "ORDER BY events.value DESC, event_id LIMIT 500",
)
def _(spark, sf):
    e = load(spark, sf, "events").withColumn("raw", F.col("value"))
    odd = F.when(F.col("user_id") % 10 == 0, F.lit(float("nan"))).when(F.col("user_id") % 5 == 0, F.lit(float("inf")))
    e = e.withColumn("value", F.coalesce(odd, F.col("value")))
    return clean.safe_head(e, 500, F.desc("raw"), F.asc("event_id")).select("event_id", "value")


_TRANSFORM = f"""
    WITH d AS (SELECT DISTINCT * FROM ({t.LINEITEM_NULLS} UNION ALL {t.LINEITEM_NULLS} WHERE l_orderkey % 10 = 0)),
    s AS (SELECT quantile_cont(l_quantity, 0.5) AS med FROM d),
    m AS (SELECT l_returnflag AS v FROM d WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    f AS (SELECT * REPLACE (coalesce(l_quantity, (SELECT med FROM s)) AS l_quantity,
                            coalesce(l_returnflag, (SELECT v FROM m)) AS l_returnflag) FROM d)
"""


def _dup_nulls(spark, sf):
    v = t.lineitem_nulls(spark, sf)
    return v.unionByName(v.filter("l_orderkey % 10 = 0"))


@register(
    "p08_transform",
    _TRANSFORM
    + """, b AS (SELECT min(l_quantity) lo, max(l_quantity) hi, min(l_tax) tlo, max(l_tax) thi,
                 min(l_extendedprice)::DOUBLE plo, max(l_extendedprice)::DOUBLE phi FROM f)
    SELECT l_returnflag, l_linestatus, round((l_quantity - lo) / (hi - lo), 4) AS quantity,
           round((l_tax - tlo) / (thi - tlo), 4) AS tax, count(*) AS n,
           round(min((l_extendedprice::DOUBLE - plo) / (phi - plo)), 4) AS min_price
    FROM f, b GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf):
    out = clean.transform(_dup_nulls(spark, sf), normalize=True)
    return out.groupBy(
        "l_returnflag", "l_linestatus", F.round("l_quantity", 4).alias("quantity"), F.round("l_tax", 4).alias("tax")
    ).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("l_extendedprice"), 4).alias("min_price"))


@register(
    "p08_transform_log",
    f"""
    WITH a AS (SELECT count(*) AS n FROM ({t.LINEITEM_DUPS})),
    d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM ({t.LINEITEM_DUPS})))
    SELECT step, detail, rows FROM a, d, LATERAL (VALUES
      ('duplicates', 'Removed ' || (a.n - d.n) || ' duplicate rows', a.n - d.n),
      ('dates', 'Parsed date columns: [''l_shipdate'']', d.n),
      ('done', 'Transformation complete: ' || d.n || ' rows remaining (removed ' || (a.n - d.n) || ')', d.n)) v(step, detail, rows)
    """,
)
def _(spark, sf):
    return clean.transform_log(t.lineitem_dups(spark, sf))


@register(
    "p09_minmax",
    "WITH b AS (SELECT min(s_acctbal) lo, max(s_acctbal) hi FROM supplier) SELECT s_suppkey, 5.0::DOUBLE AS k, "
    "round((s_acctbal - lo) / (hi - lo), 4) AS s_acctbal FROM supplier, b",
)
def _(spark, sf):
    s = load(spark, sf, "supplier").select("s_suppkey", F.lit(5.0).alias("k"), "s_acctbal")
    return clean.minmax(s, ["k", "s_acctbal"]).withColumn("s_acctbal", F.round("s_acctbal", 4))


@register(
    "p10_parse_dates",
    "SELECT CASE WHEN event_id % 4 = 0 THEN NULL ELSE date_trunc('day', ts) END::TIMESTAMP AS event_date, count(*) AS n "
    "FROM events GROUP BY 1",
)
def _(spark, sf):
    out = clean.parse_dates(_events_text(spark, sf))
    return out.groupBy(F.col("event_date").cast("timestamp_ntz").alias("event_date")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "p11_clean",
    _TRANSFORM + "SELECT l_returnflag, l_quantity::DOUBLE AS l_quantity, count(*) AS n FROM f GROUP BY 1, 2",
)
def _(spark, sf):
    out = clean.clean(_dup_nulls(spark, sf))
    return out.groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"))


@register(
    "p12_label_encode",
    "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus, "
    "dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders",
)
def _(spark, sf):
    return clean.label_encode(load(spark, sf, "orders")).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@register(
    "p13_standardize",
    "WITH s AS (SELECT avg(c_acctbal) mu, stddev_pop(c_acctbal) sd FROM customer) "
    "SELECT c_custkey, 0.0::DOUBLE AS k, round((c_acctbal - mu) / sd, 4) AS c_acctbal FROM customer, s",
)
def _(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", F.lit(5.0).alias("k"), "c_acctbal")
    return clean.standardize(c, ["k", "c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 4))


@register(
    "p14_datetime_features",
    "SELECT o_orderkey, year(o_orderdate)::INTEGER AS o_orderdate_year, month(o_orderdate)::INTEGER AS o_orderdate_month, "
    "day(o_orderdate)::INTEGER AS o_orderdate_day, (isodow(o_orderdate) - 1)::INTEGER AS o_orderdate_dayofweek FROM orders",
)
def _(spark, sf):
    return clean.datetime_features(load(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@register(
    "p15_ratio_feature",
    "SELECT p_partkey, round(p_retailprice / (p_size + 1e-9), 4) AS p_retailprice_to_p_size_ratio FROM part",
)
def _(spark, sf):
    out = clean.ratio_feature(load(spark, sf, "part"), "p_retailprice", "p_size")
    return out.select("p_partkey", F.round("p_retailprice_to_p_size_ratio", 4).alias("p_retailprice_to_p_size_ratio"))


@register("p16_sample_n", "SELECT * FROM orders ORDER BY md5('42|' || o_orderkey::VARCHAR), o_orderkey LIMIT 500")
def _(spark, sf):
    return clean.sample_n(load(spark, sf, "orders"), 500, "o_orderkey")


@register("p17_duplicate_count", f"SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({t.LINEITEM_DUPS}))) AS duplicates FROM ({t.LINEITEM_DUPS})")
def _(spark, sf):
    return clean.duplicate_count(t.lineitem_dups(spark, sf))


@register(
    "p18_search_rows",
    "SELECT doc_id, lang, source, n_chars FROM documents WHERE contains(lower(text), 'tion') OR contains(lower(source), 'tion') "
    "ORDER BY doc_id LIMIT 50 OFFSET 50",
)
def _(spark, sf):
    found = clean.search_rows(load(spark, sf, "documents"), "TION", [F.col("doc_id")], 2, 50, ["text", "source"])
    return found.select("doc_id", "lang", "source", "n_chars")


@register(
    "p19_apply_edits",
    "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 6 = 0 THEN 2.5 WHEN c_custkey % 3 = 0 THEN 1.5 ELSE c_acctbal END AS c_acctbal, "
    "CASE WHEN c_custkey % 5 = 0 THEN 'EDITED' ELSE c_mktsegment END AS c_mktsegment FROM customer",
)
def _(spark, sf):
    c = load(spark, sf, "customer")
    part = lambda cond, column, value, seq: c.filter(cond).select(
        F.col("c_custkey").alias("key"), F.lit(column).alias("column"), F.lit(value).alias("value"), F.lit(seq).alias("seq")
    )
    edits = (
        part("c_custkey % 3 = 0", "c_acctbal", "1.5", 1)
        .unionByName(part("c_custkey % 6 = 0", "c_acctbal", "2.5", 2))
        .unionByName(part("c_custkey % 5 = 0", "c_mktsegment", "EDITED", 3))
        .unionByName(part("c_custkey % 7 = 0", "c_nationkey", "not a number", 4))
    )
    return clean.apply_edits(c, edits, "c_custkey")


# --- profiles ---------------------------------------------------------------

_TYPES = {"l_linenumber": "int", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
          "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_extendedprice": "decimal(18,2)"}


@register(
    "e01_summary",
    " UNION ALL ".join(
        f"SELECT {i}::INTEGER AS ordinal, '{c}' AS \"column\", '{_TYPES.get(c, 'double')}' AS dtype, count(*) AS n_rows, "
        f"count(*) - count({c}) AS missing FROM ({t.LINEITEM_NULLS})"
        for i, c in enumerate(_LI)
    ),
)
def _(spark, sf):
    return profile.summary(t.lineitem_nulls(spark, sf))


_MISSING = "(count(*) - count(l_quantity) + count(*) - count(l_returnflag))"


@register(
    "e02_completeness",
    f"SELECT count(*) AS n_rows, 11::INTEGER AS n_cols, count(*) * 11 AS total_cells, {_MISSING} AS total_missing, "
    f"round((1 - {_MISSING} / (count(*) * 11)) * 100, 1) AS completeness FROM ({t.LINEITEM_NULLS})",
)
def _(spark, sf):
    return profile.completeness(t.lineitem_nulls(spark, sf))


@register(
    "e03_value_counts",
    union_all(
        "SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS count FROM (" + t.LINEITEM_NULLS + ") WHERE {c} IS NOT NULL GROUP BY 2",
        ["l_returnflag", "l_linestatus", "l_linenumber", "l_shipdate"],
    ),
)
def _(spark, sf):
    return profile.value_counts_long(t.lineitem_nulls(spark, sf), ["l_returnflag", "l_linestatus", "l_linenumber", "l_shipdate"])


def _profile_sql(view: str, columns: list[str], numeric: set[str], d: int) -> str:
    parts = []
    for i, c in enumerate(columns):
        n = c in numeric
        stat = lambda e: f"round(({e})::DOUBLE, {d})" if n else "NULL::DOUBLE"  # noqa: E731,B023
        top = f"(SELECT {c}::VARCHAR FROM v WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
        top_n = f"coalesce((SELECT count(*) FROM v WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 1 DESC LIMIT 1), 0)"
        parts.append(
            f"SELECT {i}::INTEGER AS ordinal, '{c}' AS \"column\", '{'number' if n else 'text'}' AS dtype, "
            f"count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*) * 100, 1) AS missing_pct, "
            f"count(DISTINCT {c}) AS n_unique, {stat(f'min({c})')} AS min, {stat(f'max({c})')} AS max, "
            f"{stat(f'sum({c})::DOUBLE / count({c})')} AS mean, {stat(f'quantile_cont({c}::DOUBLE, 0.5)')} AS median, "
            f"{stat(f'stddev_samp({c}::DOUBLE)')} AS std, {'NULL::VARCHAR' if n else top} AS top, "
            f"{'NULL::BIGINT' if n else top_n} AS top_count FROM v"
        )
    return f"WITH v AS ({view}) " + " UNION ALL ".join(parts)


@register("e04_profile_columns", _profile_sql(t.LINEITEM_NULLS, _LI, set(t.LINEITEM_NUMBERS), 2))
def _(spark, sf):
    return profile.profile_columns(t.lineitem_nulls(spark, sf))


@register("e05_profile_columns_dashboard", _profile_sql(t.ORDERS, _ORD, {"o_orderkey", "o_custkey", "o_totalprice"}, 3))
def _(spark, sf):
    return profile.profile_columns(t.orders(spark, sf), "dashboard")


_NO_NUM = "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS missing_pct"


def planner_profile_sql(dataset: str, view: str, numbers: dict[str, int], texts: dict[str, int], dates: dict[str, int]) -> str:
    parts = [
        f"SELECT '{dataset}' AS dataset, {i}::INTEGER AS ordinal, '{c}' AS \"column\", 'numeric' AS kind, round(min({c})::DOUBLE, 3) AS min, "
        f"round(max({c})::DOUBLE, 3) AS max, round(sum({c})::DOUBLE / count({c}), 3) AS mean, "
        f"round((count(*) - count({c})) / count(*) * 100, 1) AS missing_pct, NULL::BIGINT AS n_unique, "
        f"NULL::VARCHAR AS cardinality, NULL::VARCHAR AS top FROM ({view})"
        for c, i in numbers.items()
    ]
    parts += [
        f"SELECT '{dataset}' AS dataset, {i}::INTEGER AS ordinal, '{c}' AS \"column\", 'category' AS kind, NULL::DOUBLE AS min, "
        f"NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS missing_pct, n_unique, {_CARD} AS cardinality, top FROM ("
        f"SELECT count(DISTINCT {c}) AS n_unique, (SELECT {c} FROM ({view}) WHERE {c} IS NOT NULL GROUP BY 1 "
        f"ORDER BY count(*) DESC, 1 LIMIT 1) AS top FROM ({view}))"
        for c, i in texts.items()
    ]
    parts += [
        f"SELECT '{dataset}', {i}::INTEGER, '{c}', 'date', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ({view}) HAVING count({c}) > 0"
        for c, i in dates.items()
    ]
    return " UNION ALL ".join(parts)


_E06 = planner_profile_sql(
    "lineitem", t.LINEITEM_NULLS, {c: i for i, c in enumerate(t.LINEITEM_NUMBERS)},
    {"l_returnflag": 8, "l_linestatus": 9}, {"l_shipdate": 10},
)


@register("e06_planner_profile", _E06)
def _(spark, sf):
    return profile.planner_profile(t.lineitem_nulls(spark, sf), "lineitem")


def _outliers(c: str, v: str = "v") -> str:
    q = f"(SELECT quantile_cont({c}::DOUBLE, [0.25, 0.75]) FROM {v})"
    iqr = f"({q}[2] - {q}[1])"
    return f"count(*) FILTER (WHERE {c} < {q}[1] - 1.5 * {iqr} OR {c} > {q}[2] + 1.5 * {iqr})"


@register(
    "e07_ml_numeric_profile",
    f"WITH v AS ({t.LINEITEM_NULLS}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(min({c})::DOUBLE, 3) AS min, round(max({c})::DOUBLE, 3) AS max, "
        f"round(sum({c})::DOUBLE / count({c}), 3) AS mean, round(stddev_samp({c}::DOUBLE), 3) AS std, "
        f"round((count(*) - count({c})) / count(*) * 100, 1) AS missing_pct, round(skewness({c}::DOUBLE), 2) AS skew, "
        f"round({_outliers(c)} / count({c}), 3) AS outlier_rate FROM v"
        for c in t.LINEITEM_NUMBERS
    ),
)
def _(spark, sf):
    return profile.ml_numeric_profile(t.lineitem_nulls(spark, sf))


@register(
    "e07_ml_categorical_profile",
    f"SELECT \"column\", n_unique, {_CARD} AS cardinality, missing_pct, top_value FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, round((count(*) - count({c})) / count(*) * 100, 1) AS missing_pct, "
        f"(SELECT {c} FROM ({t.LINEITEM_NULLS}) WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_value "
        f"FROM ({t.LINEITEM_NULLS})"
        for c in ("l_returnflag", "l_linestatus")
    )
    + ")",
)
def _(spark, sf):
    return profile.ml_categorical_profile(t.lineitem_nulls(spark, sf))


@register(
    "e07_ml_table_profile",
    f"SELECT count(*) AS n_rows, 11::INTEGER AS n_cols, 8::INTEGER AS n_numeric, 2::INTEGER AS n_categorical, 0::INTEGER AS n_date, "
    f"0::INTEGER AS n_text, round({_MISSING} / count(*) / 11 * 100, 1) AS total_missing_pct FROM ({t.LINEITEM_NULLS})",
)
def _(spark, sf):
    return profile.ml_table_profile(t.lineitem_nulls(spark, sf))


@register(
    "e08_target_profile_classes",
    f"""
    WITH v AS ({t.LINEITEM_NULLS}), c AS (SELECT l_returnflag AS label, count(*) AS n FROM v WHERE l_returnflag IS NOT NULL GROUP BY 1)
    SELECT 'n_classes' AS item, count(*)::DOUBLE AS value FROM c
    UNION ALL SELECT 'imbalance_ratio', round(max(n) / min(n), 2) FROM c
    UNION ALL SELECT 'missing_pct', round((count(*) - count(l_returnflag)) / count(*) * 100, 1) FROM v
    UNION ALL (SELECT 'class:' || label, n::DOUBLE FROM c ORDER BY n DESC, label LIMIT 10)
    """,
)
def _(spark, sf):
    return profile.target_profile(t.lineitem_nulls(spark, sf), "l_returnflag")


@register(
    "e08_target_profile_number",
    f"""
    WITH s AS (SELECT count(DISTINCT l_quantity)::DOUBLE AS a, round(min(l_quantity), 3) AS b, round(max(l_quantity), 3) AS c,
      round(avg(l_quantity), 3) AS d, round(stddev_samp(l_quantity), 3) AS e,
      round((count(*) - count(l_quantity)) / count(*) * 100, 1) AS f, round(skewness(l_quantity), 2) AS g FROM ({t.LINEITEM_NULLS}))
    SELECT item, value FROM s, LATERAL (VALUES ('n_unique', a), ('min', b), ('max', c), ('mean', d), ('std', e),
      ('missing_pct', f), ('skew', g)) v(item, value)
    """,
)
def _(spark, sf):
    return profile.target_profile(t.lineitem_nulls(spark, sf), "l_quantity")


def eda_sql(view: str, names) -> str:
    return f"WITH v AS ({view}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(sum({c})::DOUBLE / count({c}), 4) AS mean, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, "
        f"round(stddev_samp({c}::DOUBLE), 4) AS std, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, "
        f"round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q1, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q3, "
        f"round(skewness({c}::DOUBLE), 4) AS skew, round(kurtosis({c}::DOUBLE), 4) AS kurtosis, "
        f"count(*) - count({c}) AS missing, {_outliers(c)} AS outliers FROM v"
        for c in names
    )


@register("e09_eda_stats", eda_sql(t.LINEITEM_NULLS, t.LINEITEM_NUMBERS))
def _(spark, sf):
    return profile.eda_stats(t.lineitem_nulls(spark, sf))


def corr_sql(view: str, names, digits: int) -> str:
    return f"WITH v AS ({view}) " + " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, "
        + (
            f"CASE WHEN stddev_pop({x}::DOUBLE) > 0 THEN 1.0::DOUBLE END AS r FROM v"
            if x == y
            else f"CASE WHEN isnan(corr({x}::DOUBLE, {y}::DOUBLE)) THEN NULL ELSE round(corr({x}::DOUBLE, {y}::DOUBLE), {digits}) END AS r FROM v"
        )
        for x in names
        for y in names
    )


@register("e10_corr_matrix", corr_sql(t.LINEITEM_NULLS, t.LINEITEM_NUMBERS, 4))
def _(spark, sf):
    return profile.corr_matrix(t.lineitem_nulls(spark, sf))


@register(
    "e11_category_distributions",
    "SELECT \"column\", rank, value, count FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY count DESC, value) AS rank FROM ("
    + union_all("SELECT '{c}' AS \"column\", {c} AS value, count(*) AS count FROM part GROUP BY 2", ["p_name", "p_brand", "p_type"])
    + ")) WHERE rank <= 10",
)
def _(spark, sf):
    return profile.category_distributions(load(spark, sf, "part"))


def _describe_sql(view: str, columns: list[str], numeric: set[str]) -> str:
    parts = []
    for i, c in enumerate(columns):
        n = c in numeric
        num = lambda e: f"round(({e})::DOUBLE, 4)" if n else "NULL::DOUBLE"  # noqa: E731,B023
        top = f"(SELECT {c}::VARCHAR FROM v WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
        freq = f"(SELECT count(*) FROM v WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 1 DESC LIMIT 1)"
        parts.append(
            f"SELECT {i}::INTEGER AS ordinal, '{c}' AS \"column\", count({c}) AS count, "
            f"{'NULL::BIGINT' if n else f'count(DISTINCT {c})'} AS \"unique\", {'NULL::VARCHAR' if n else top} AS top, "
            f"{'NULL::BIGINT' if n else freq} AS freq, {num(f'sum({c})::DOUBLE / count({c})')} AS mean, "
            f"{num(f'stddev_samp({c}::DOUBLE)')} AS std, {num(f'min({c})')} AS min, {num(f'quantile_cont({c}::DOUBLE, 0.25)')} AS q25, "
            f"{num(f'quantile_cont({c}::DOUBLE, 0.5)')} AS q50, {num(f'quantile_cont({c}::DOUBLE, 0.75)')} AS q75, "
            f"{num(f'max({c})')} AS max, count(*) - count({c}) AS nulls FROM v"
        )
    return f"WITH v AS ({view}) " + " UNION ALL ".join(parts)


@register("e12_describe_all", _describe_sql(t.LINEITEM_NULLS, _LI, set(t.LINEITEM_NUMBERS)))
def _(spark, sf):
    return profile.describe_all(t.lineitem_nulls(spark, sf))


@register(
    "e13_column_means",
    union_all("SELECT '{c}' AS \"column\", round(sum({c})::DOUBLE / count({c}), 4) AS mean FROM (" + t.LINEITEM_NULLS + ")", t.LINEITEM_NUMBERS),
)
def _(spark, sf):
    return profile.column_means(t.lineitem_nulls(spark, sf))


@register(
    "n01_fold_missing",
    "SELECT count(*) AS n_rows, count(*) FILTER (WHERE user_id % 5 <> 0) AS n_value FROM events",
)
def _(spark, sf):
    e = load(spark, sf, "events")
    odd = F.when(F.col("user_id") % 10 == 0, F.lit(float("nan"))).when(F.col("user_id") % 5 == 0, F.lit(float("-inf")))
    folded = S.fold_missing(e.withColumn("value", F.coalesce(odd, F.col("value"))))
    return folded.agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_value"))
