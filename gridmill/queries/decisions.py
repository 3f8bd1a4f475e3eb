"""Queries on findings, chart plans and algorithm shortlists."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.functions import semantics as S
from gridmill.operators import insights, kpi, profile, timeagg, typing
from gridmill.plans import catalog, dashboards, shortlist
from gridmill.queries import register
from gridmill.queries import tables as t
from gridmill.queries.columns import planner_profile_sql
from gridmill.queries.kpis import ORDER_ROLES, growth_sql
from gridmill.queries.tables import load
from gridmill.session import pinned

# --- findings ---------------------------------------------------------------

_ROLES = {"value": "l_extendedprice", "qty": "l_quantity", "date": "l_shipdate", "category": "l_returnflag"}


def _only(kind: str):
    def run(spark, sf):
        return insights.insights(_insight_table(spark, sf), _INSIGHT_ROLES, "o_orderkey").filter(F.col("type") == kind)

    return run


_INSIGHT_ROLES = {"value": "price", "date": "o_orderdate", "category": "o_orderpriority"}
# prices with spikes and gaps, and a column that follows the price
_INSIGHT_SQL = (
    "SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_orderpriority, "
    "CAST(CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice * 10 ELSE o_totalprice END AS DECIMAL(18,2)) AS price, "
    "CAST(CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice * 10 ELSE o_totalprice END * 0.5 + o_custkey AS DECIMAL(18,2)) AS follows FROM orders"
)


def _insight_table(spark, sf):
    price = "CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice * 10 ELSE o_totalprice END"
    return load(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_orderdate", "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus",
        "o_orderpriority", f"CAST({price} AS DECIMAL(18,2)) AS price",
        f"CAST({price} * 0.5 + o_custkey AS DECIMAL(18,2)) AS follows",
    )


def _trend_sql(value: str, growth: str) -> str:
    return (
        f"SELECT 'all' AS segment, 'trend' AS type, CASE WHEN growth_pct > 0 THEN 'Positive' ELSE 'Negative' END || ' Growth Detected' AS title, "
        f"'{value} has ' || CASE WHEN growth_pct > 0 THEN 'increased' ELSE 'decreased' END || ' by ' || printf('%.1f', round(abs(growth_pct), 1)) || "
        f"'% comparing the first and second half of the dataset.' AS body, CASE WHEN growth_pct > 0 THEN 'success' ELSE 'warning' END AS severity "
        f"FROM ({growth})"
    )


register("i01_growth_insight", _trend_sql("price", growth_sql(_INSIGHT_SQL, "o_orderdate", "price", "o_orderkey")))(_only("trend"))
register(
    "i02_top_performer",
    f"""
    WITH g AS (SELECT o_orderpriority AS label, sum(price)::DOUBLE AS v FROM ({_INSIGHT_SQL}) GROUP BY 1),
    b AS (SELECT label, round(v / (SELECT sum(v) FROM g) * 100, 1) AS pct FROM g ORDER BY v DESC, label LIMIT 1)
    SELECT 'all' AS segment, 'top_performer' AS type, 'Top Performer: ' || label AS title,
           '''' || label || ''' accounts for ' || pct || '% of total price.' AS body, 'info' AS severity FROM b
    """,
)(_only("top_performer"))
register(
    "i03_missing_insight",
    f"""
    WITH m AS (SELECT round((count(*) - count(o_orderstatus)) / (count(*) * 6) * 100, 1) AS pct FROM ({_INSIGHT_SQL}))
    SELECT 'all' AS segment, 'quality' AS type, pct || '% Missing Data Detected' AS title,
           'The dataset has ' || pct || '% missing values.' AS body, 'warning' AS severity FROM m WHERE pct > 5
    """,
)(_only("quality"))
register(
    "i04_outlier_insight",
    f"""
    WITH v AS ({_INSIGHT_SQL}), q AS (SELECT quantile_cont(price::DOUBLE, 0.25) AS a, quantile_cont(price::DOUBLE, 0.75) AS b FROM v),
    o AS (SELECT count(*) FILTER (WHERE price < a - 1.5 * (b - a) OR price > b + 1.5 * (b - a)) AS n, count(price) AS m FROM v, q)
    SELECT 'all' AS segment, 'anomaly' AS type, n || ' Outliers in price' AS title,
           'Found ' || n || ' statistical outliers (' || round(n / m * 100, 1) || '% of data).' AS body, 'warning' AS severity FROM o WHERE n > 0
    """,
)(_only("anomaly"))


@register(
    "i05_large_table_insight",
    """
    SELECT 'all' AS segment, 'scale' AS type, 'Large Dataset' AS title,
           'Dataset has ' || format('{:,}', count(*)) || ' rows.' AS body, 'info' AS severity
    FROM lineitem HAVING count(*) > 1000
    """,
)
def _(spark, sf):
    li = load(spark, sf, "lineitem").select("l_quantity")
    return insights.insights(li, {"value": "l_quantity"}, large_rows=1000).filter(F.col("type") == "scale")


register(
    "i06_correlation_insight",
    f"""
    WITH v AS ({_INSIGHT_SQL}), r AS (SELECT * FROM (
      SELECT 'o_orderkey' AS c, abs(corr(o_orderkey::DOUBLE, price::DOUBLE)) AS r FROM v UNION ALL
      SELECT 'follows', abs(corr(follows::DOUBLE, price::DOUBLE)) FROM v) ORDER BY r DESC LIMIT 1)
    SELECT 'all' AS segment, 'correlation' AS type, 'Strong Correlation Found' AS title,
           '''' || c || ''' has a ' || printf('%.2f', round(round(r, 3), 2)) || ' correlation with ''price''.' AS body, 'success' AS severity
    FROM r WHERE round(r, 3) > 0.5
    """,
)(_only("correlation"))

_SEG = "o_orderpriority"


@register(
    "i01_i06_insights_by_segment",
    f"""
    WITH v AS (SELECT *, o_orderpriority AS segment FROM ({_INSIGHT_SQL})),
    halves AS (SELECT segment, price, row_number() OVER (PARTITION BY segment ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY segment) AS n FROM v),
    g AS (SELECT segment, sum(price) FILTER (WHERE rn <= n // 2)::DOUBLE AS a, sum(price) FILTER (WHERE rn > n // 2)::DOUBLE AS b FROM halves GROUP BY 1),
    gr AS (SELECT segment, round((b - a) / a * 100, 2) AS x FROM g),
    q AS (SELECT segment, quantile_cont(price::DOUBLE, 0.25) AS q1, quantile_cont(price::DOUBLE, 0.75) AS q3 FROM v GROUP BY 1),
    o AS (SELECT v.segment, count(*) FILTER (WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)) AS n, count(price) AS m
          FROM v JOIN q ON v.segment = q.segment GROUP BY 1),
    m AS (SELECT segment, round((count(*) - count(o_orderstatus)) / (count(*) * 6) * 100, 1) AS pct FROM v GROUP BY 1),
    s AS (SELECT segment, coalesce(o_orderstatus, '') AS label, sum(price)::DOUBLE AS x FROM v WHERE o_orderstatus IS NOT NULL GROUP BY 1, 2),
    tp AS (SELECT segment, label, round(x / sum(x) OVER (PARTITION BY segment) * 100, 1) AS pct,
                 row_number() OVER (PARTITION BY segment ORDER BY x DESC, label) AS rn FROM s),
    c AS (SELECT segment, round(abs(corr(follows::DOUBLE, price::DOUBLE)), 3) AS r FROM v GROUP BY 1)
    SELECT segment, 'trend' AS type, CASE WHEN x > 0 THEN 'Positive' ELSE 'Negative' END || ' Growth Detected' AS title FROM gr
    UNION ALL SELECT segment, 'anomaly', n || ' Outliers in price' FROM o WHERE n > 0
    UNION ALL SELECT segment, 'quality', pct || '% Missing Data Detected' FROM m WHERE pct > 5
    UNION ALL SELECT segment, 'top_performer', 'Top Performer: ' || label FROM tp WHERE rn = 1
    UNION ALL SELECT segment, 'correlation', 'Strong Correlation Found' FROM c WHERE r > 0.5
    """,
)
def _(spark, sf):
    roles = {"value": "price", "date": "o_orderdate", "category": "o_orderstatus"}
    return insights.insights(_insight_table(spark, sf), roles, "o_orderkey", by=_SEG).select("segment", "type", "title")


# --- chart plans ------------------------------------------------------------

_PROFILES = {
    "lineitem": planner_profile_sql(
        "lineitem", "SELECT * FROM lineitem", {c: i for i, c in enumerate(t.LINEITEM_NUMBERS)},
        {"l_returnflag": 8, "l_linestatus": 9}, {"l_shipdate": 10},
    ),
    "part": planner_profile_sql(
        "part", "SELECT * FROM part", {"p_partkey": 0, "p_size": 4, "p_retailprice": 5}, {"p_name": 1, "p_brand": 2, "p_type": 3}, {},
    ),
    "nation": planner_profile_sql("nation", "SELECT * FROM nation", {"n_nationkey": 0, "n_regionkey": 2}, {"n_name": 1}, {}),
    "pages": planner_profile_sql("pages", "SELECT url, html FROM pages", {}, {"url": 0, "html": 1}, {}),
}
_PROFILE_SQL = " UNION ALL ".join(f"SELECT dataset, ordinal, \"column\", kind, cardinality FROM ({q})" for q in _PROFILES.values())


def profiles(spark, sf):
    out = None
    for name in _PROFILES:
        df = load(spark, sf, name)
        if name == "pages":
            df = df.select("url", "html")
        one = profile.planner_profile(df, name)
        out = one if out is None else out.unionByName(one)
    return pinned(out)


_RULES_SQL = f"""
    WITH p AS ({_PROFILE_SQL}),
    f AS (SELECT dataset,
      list("column" ORDER BY ordinal) FILTER (WHERE kind = 'numeric') AS num,
      list("column" ORDER BY ordinal) FILTER (WHERE kind = 'date') AS dates,
      list("column" ORDER BY ordinal) FILTER (WHERE kind = 'category') AS cats,
      list("column" ORDER BY ordinal) FILTER (WHERE cardinality = 'low') AS low,
      list("column" ORDER BY ordinal) FILTER (WHERE cardinality = 'mid') AS mid,
      list("column" ORDER BY ordinal) FILTER (WHERE cardinality = 'high') AS high FROM p GROUP BY dataset),
    r AS (
      SELECT dataset, 1 AS k, 'time_series' AS chart_id, dates[1] AS x, num[1] AS y, NULL AS cols, num[1] || ' over time' AS title FROM f WHERE dates[1] IS NOT NULL AND num[1] IS NOT NULL
      UNION ALL SELECT dataset, 2, 'bar', coalesce(low[1], mid[1]), num[1], NULL, num[1] || ' by ' || coalesce(low[1], mid[1]) FROM f WHERE coalesce(low[1], mid[1]) IS NOT NULL AND num[1] IS NOT NULL
      UNION ALL SELECT dataset, 3, 'donut', low[2], num[1], NULL, 'Share of ' || num[1] || ' by ' || low[2] FROM f WHERE low[2] IS NOT NULL AND num[1] IS NOT NULL
      UNION ALL SELECT dataset, 4, 'histogram', num[1], NULL, NULL, num[1] || ' distribution' FROM f WHERE num[1] IS NOT NULL
      UNION ALL SELECT dataset, 5, 'scatter', num[2], num[1], NULL, num[2] || ' vs ' || num[1] FROM f WHERE num[2] IS NOT NULL
      UNION ALL SELECT dataset, 6, 'heatmap', NULL, NULL, array_to_string(num[1:8], ','), 'Correlation between numeric columns' FROM f WHERE len(num) >= 3
      UNION ALL SELECT dataset, 7, 'hbar', high[1], num[1], NULL, 'Top 15 ' || high[1] || ' by ' || num[1] FROM f WHERE high[1] IS NOT NULL AND num[1] IS NOT NULL
      UNION ALL SELECT dataset, 8, 'cat_counts', cats[1], NULL, NULL, 'Frequency of ' || cats[1] FROM f WHERE num IS NULL AND cats[1] IS NOT NULL
      UNION ALL SELECT dataset, 9, 'pareto', mid[1], num[1], NULL, 'Pareto of ' || num[1] || ' by ' || mid[1] FROM f WHERE mid[1] IS NOT NULL AND num[1] IS NOT NULL
      UNION ALL SELECT dataset, 10, 'radar', NULL, NULL, array_to_string(num[1:6], ','), 'Numeric feature profile' FROM f WHERE len(num) >= 4),
    rules AS (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY k) AS rank, chart_id, x, y, cols, title FROM r)
"""


def _flat(picks):
    return picks.select("dataset", "rank", "chart_id", "x", "y", F.array_join("cols", ",").alias("cols"), "title")


@register("i07_plan_charts", _RULES_SQL + "SELECT * FROM rules")
def _(spark, sf):
    return _flat(dashboards.plan_charts(profiles(spark, sf)))


# Suggestions made from the profile itself: every category against every
# number as a bar (twice), one unknown chart, one unknown column, one heatmap.
_SUGGEST_SQL = """
    , s0 AS (
      SELECT c.dataset, c.ordinal * 100 + n.ordinal AS o, 'bar' AS chart_id, c."column" AS x, n."column" AS y, NULL::VARCHAR AS cols
      FROM p c JOIN p n ON c.dataset = n.dataset WHERE c.kind = 'category' AND n.kind = 'numeric' AND n.ordinal = 0
      UNION ALL SELECT c.dataset, 5000 + c.ordinal * 100 + n.ordinal, 'bar', c."column", n."column", NULL FROM p c JOIN p n ON c.dataset = n.dataset
      WHERE c.kind = 'category' AND n.kind = 'numeric' AND n.ordinal = 0
      UNION ALL SELECT dataset, 9001, 'sunburst', 'x', 'y', NULL FROM p WHERE ordinal = 0
      UNION ALL SELECT dataset, 9002, 'pie', 'no_such_column', NULL, NULL FROM p WHERE ordinal = 0
      UNION ALL SELECT dataset, 9003, 'heatmap', NULL, NULL, string_agg("column", ',' ORDER BY ordinal) FROM p WHERE kind = 'numeric' GROUP BY dataset),
    s AS (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY o) AS rank, chart_id, x, y, cols FROM s0)
"""


def suggested(spark, sf):
    p = profiles(spark, sf)
    number = p.filter("kind = 'numeric' AND ordinal = 0").select("dataset", F.col("column").alias("y"), F.col("ordinal").alias("no"))
    cats = p.filter("kind = 'category'").select("dataset", F.col("column").alias("x"), "ordinal")
    bars = cats.join(number, "dataset").select(
        "dataset", F.explode(F.array(F.lit(0), F.lit(5000))).alias("again"), "x", "y", "ordinal", "no"
    ).select("dataset", (F.col("again") + F.col("ordinal") * 100 + F.col("no")).alias("o"), F.lit("bar").alias("chart_id"), "x", "y",
             F.lit(None).cast("array<string>").alias("cols"))
    first = p.filter("ordinal = 0").select("dataset").distinct()
    none = F.lit(None).cast("array<string>").alias("cols")
    odd = first.select("dataset", F.lit(9001).alias("o"), F.lit("sunburst").alias("chart_id"), F.lit("x").alias("x"), F.lit("y").alias("y"), none)
    gone = first.select("dataset", F.lit(9002).alias("o"), F.lit("pie").alias("chart_id"), F.lit("no_such_column").alias("x"),
                        F.lit(None).cast("string").alias("y"), none)
    heat = p.filter("kind = 'numeric'").groupBy("dataset").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column"))), lambda s: s["column"]).alias("cols")
    ).select("dataset", F.lit(9003).alias("o"), F.lit("heatmap").alias("chart_id"), F.lit(None).cast("string").alias("x"),
             F.lit(None).cast("string").alias("y"), "cols")
    from pyspark.sql import Window

    allp = bars.unionByName(odd).unionByName(gone).unionByName(heat)
    text = F.lit(None).cast("string")
    return allp.select(
        "dataset", F.row_number().over(Window.partitionBy("dataset").orderBy("o")).cast("bigint").alias("rank"), "chart_id", "x", "y",
        text.alias("grp"), text.alias("r"), text.alias("y2"), "cols", text.alias("agg"), F.lit(None).cast("int").alias("top_n"),
        text.alias("title"), text.alias("why"),
    )


_VALID = """
    , v AS (SELECT s.dataset, s.rank, s.chart_id, s.x, s.y, s.cols,
        CASE s.chart_id WHEN 'bar' THEN 'Bar Chart' ELSE 'Correlation Heatmap' END AS title FROM s
      WHERE (chart_id = 'bar' AND EXISTS (SELECT 1 FROM p WHERE p.dataset = s.dataset AND p."column" = s.x)) OR (chart_id = 'heatmap' AND cols <> ''))
"""


@register("i08_validate_picks", _RULES_SQL + _SUGGEST_SQL + _VALID + "SELECT * FROM v")
def _(spark, sf):
    return _flat(dashboards.validate_picks(suggested(spark, sf), profiles(spark, sf)))


_DEDUPED = """
    , d AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY dataset, chart_id, x, y ORDER BY rank) AS n FROM v) WHERE n = 1)
"""


@register(
    "i09_dedupe_picks",
    _RULES_SQL + _SUGGEST_SQL + _VALID + _DEDUPED
    + "SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY rank) AS rank, chart_id, x, y, cols, title FROM d",
)
def _(spark, sf):
    return _flat(dashboards.dedupe_picks(dashboards.validate_picks(suggested(spark, sf), profiles(spark, sf))))


@register(
    "i10_top_up_picks",
    _RULES_SQL + _SUGGEST_SQL + _VALID
    + """
    , n AS (SELECT dataset, (SELECT count(*) FROM v WHERE v.dataset = q.dataset) AS valid FROM (SELECT DISTINCT dataset FROM p) q),
    u AS (SELECT v.dataset, 0 AS late, rank, chart_id, x, y, cols, title FROM v
          UNION ALL SELECT r.dataset, 1, rank, chart_id, x, y, cols, title FROM rules r JOIN n USING (dataset) WHERE valid < 4 AND NOT EXISTS
            (SELECT 1 FROM v WHERE v.dataset = r.dataset AND v.chart_id = r.chart_id AND v.x IS NOT DISTINCT FROM r.x AND v.y IS NOT DISTINCT FROM r.y)),
    w AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY late, rank) AS k FROM u)
    SELECT dataset, k AS rank, chart_id, x, y, cols, title FROM w WHERE late = 0 OR k <= 8
    """,
)
def _(spark, sf):
    p = profiles(spark, sf)
    return _flat(dashboards.top_up_picks(dashboards.validate_picks(suggested(spark, sf), p), p))


@register("i11_auto_dashboard")
def _(spark, sf):
    return dashboards.dashboard_long(t.orders(spark, sf), "orders", tiebreak="o_orderkey")


@register("a12_executive_dashboard")
def _(spark, sf):
    return dashboards.executive_dashboard(t.orders(spark, sf), ORDER_ROLES, "o_orderkey")


# --- shortlists -------------------------------------------------------------

_TASKS = {"classification": "o_orderstatus", "regression": "o_totalprice"}


def suggestion_profiles(spark, sf):
    """One profile row per target of the orders table, from the data."""
    o = t.orders(spark, sf).withColumn("o_orderpriority", F.expr("nullif(o_orderpriority, '5-LOW')")).withColumn(
        "o_custkey", F.expr("CASE WHEN o_custkey % 2 = 0 THEN o_custkey END")
    )
    table = profile.ml_table_profile(o)
    high = typing.cardinality(o).filter("cardinality = 'high'").limit(1).count() > 0
    out = None
    for task, target in _TASKS.items():
        ratio = profile.target_profile(o, target).filter("item = 'imbalance_ratio'").select("value").scalar()
        one = shortlist.suggestion_profile(table, typing.infer_task(o, target), task, high, ratio)
        out = one if out is None else out.unionByName(one)
    return out


_SP = """
    WITH o AS (SELECT * REPLACE (nullif(o_orderpriority, '5-LOW') AS o_orderpriority, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS o_custkey) FROM orders),
    prof AS (SELECT count(*) AS n_rows, round((count(*) - count(o_orderpriority) + count(*) - count(o_custkey)) / count(*) / 6 * 100, 1) AS miss FROM o),
    imb AS (SELECT round(max(n) / min(n), 2) AS ratio FROM (SELECT count(*) AS n FROM o GROUP BY o_orderstatus)),
    pr AS (SELECT 'classification' AS dataset, n_rows, miss, ratio FROM prof, imb UNION ALL SELECT 'regression', n_rows, miss, 1.0 FROM prof),
"""


def _algo_values() -> str:
    rows = [
        f"({i}, '{a.id}', '{a.family}', '{a.task}', {a.min_rows}, {a.max_rows or 'NULL'}, '{a.speed}', "
        f"{a.handles_missing}, {a.handles_high_cardinality}, {a.interpretable})"
        for i, a in enumerate(catalog.ALGORITHMS)
    ]
    return "a AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") v(place, id, family, task, lo, hi, speed, m, c, i)), "


_CHAMP = ", ".join(f"'{c}'" for c in catalog.CHAMPIONS)
_SCORED = f"""
    j AS (SELECT * FROM a JOIN pr ON a.task = pr.dataset),
    sc AS (SELECT *, 50.0 - (CASE WHEN speed = 'slow' AND n_rows < 500 THEN 15 ELSE 0 END) - (CASE WHEN speed = 'slow' AND n_rows > 50000 THEN 20 ELSE 0 END)
      - (CASE WHEN family IN ('Instance', 'SVM') AND n_rows > 100000 THEN 30 ELSE 0 END) + (CASE WHEN miss > 5 AND m THEN 12 ELSE 0 END)
      + (CASE WHEN ratio > 5 AND family IN ('Ensemble', 'Boosting') THEN 10 ELSE 0 END)
      + (CASE WHEN n_rows < 200 AND family IN ('Linear', 'Probabilistic', 'Discriminant') THEN 10 ELSE 0 END)
      - (CASE WHEN n_rows < 200 AND family = 'Neural' THEN 25 ELSE 0 END) + (CASE WHEN id IN ({_CHAMP}) THEN 8 ELSE 0 END) AS score,
      concat_ws('; ', CASE WHEN miss > 5 AND m THEN 'handles missing values' END, CASE WHEN i THEN 'interpretable' END,
        CASE WHEN ratio > 5 AND family IN ('Ensemble', 'Boosting') THEN 'robust to class imbalance' END,
        CASE family WHEN 'Boosting' THEN 'strong tabular baseline' WHEN 'Ensemble' THEN 'low variance' WHEN 'Linear' THEN 'fast and simple' END) AS why
      FROM j WHERE n_rows >= lo AND (hi IS NULL OR n_rows <= hi)),
    o1 AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, place) AS n,
                     row_number() OVER (PARTITION BY dataset, family ORDER BY score DESC, place) AS f FROM sc),
    sl AS (SELECT dataset, task, row_number() OVER (PARTITION BY dataset ORDER BY n) AS rank, id, family, round(score / 100, 2)::DOUBLE AS confidence,
      CASE WHEN why = '' THEN 'reasonable default for ' || n_rows || ' rows' ELSE why END AS rationale FROM o1 WHERE n <= 3 OR f = 1)
"""


@register("i12_shortlist", _SP + _algo_values() + _SCORED + "SELECT dataset, task, rank, id, family, confidence FROM sl WHERE rank <= 6")
def _(spark, sf):
    out = shortlist.shortlist(catalog.algorithm_catalog(spark), suggestion_profiles(spark, sf))
    return out.drop("rationale")


@register("i13_rationale", _SP + _algo_values() + _SCORED
          + "SELECT dataset, id, CASE WHEN why = '' THEN 'reasonable default for ' || n_rows || ' rows' ELSE why END AS rationale FROM sc")
def _(spark, sf):
    return shortlist.score_algorithms(catalog.algorithm_catalog(spark), suggestion_profiles(spark, sf)).select("dataset", "id", "rationale")


@register(
    "i14_feasible",
    _SP + _algo_values()
    + "j AS (SELECT * FROM a JOIN pr ON a.task = pr.dataset) SELECT dataset, id, n_rows >= lo AND (hi IS NULL OR n_rows <= hi) AS feasible, "
    "CASE WHEN n_rows < lo THEN 'needs at least ' || lo || ' rows' WHEN n_rows > hi THEN 'at most ' || hi || ' rows' END AS reason FROM j",
)
def _(spark, sf):
    return shortlist.feasible(catalog.algorithm_catalog(spark), suggestion_profiles(spark, sf))


@register(
    "i15_finalize_picks",
    _SP + _algo_values() + _SCORED
    + """
    , s AS (SELECT dataset, id, rank, confidence FROM (VALUES ('classification', 'lda', 2, 1.7), ('classification', 'ridge', 1, 0.5),
        ('classification', 'nonsense', 1, 0.5), ('regression', 'ridge', 1, -0.5), ('regression', 'lasso', 2, 0.4), ('regression', 'ridge', 3, 0.9),
        ('regression', 'huber', 4, 0.3)) x(dataset, id, rank, confidence)),
    v AS (SELECT s.dataset, s.id, s.rank, greatest(0.0, least(1.0, s.confidence))::DOUBLE AS confidence, 0 AS late FROM s JOIN pr USING (dataset)
          JOIN a ON a.id = s.id AND a.task = s.dataset),
    n AS (SELECT dataset, (SELECT count(*) FROM v WHERE v.dataset = pr.dataset) AS valid FROM pr),
    fl AS (SELECT dataset, id, rank, confidence, 1 AS late, row_number() OVER (PARTITION BY dataset ORDER BY rank) AS k FROM sl
           WHERE rank <= 6 AND NOT EXISTS (SELECT 1 FROM v WHERE v.dataset = sl.dataset AND v.id = sl.id)),
    u AS (SELECT * FROM v UNION ALL SELECT dataset, id, rank, confidence, late FROM fl JOIN n USING (dataset) WHERE valid < 3 AND k + valid <= 5),
    w AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY rank, late, id) AS n5 FROM u),
    d AS (SELECT *, row_number() OVER (PARTITION BY dataset, id ORDER BY n5) AS du FROM w WHERE n5 <= 5)
    SELECT dataset, id, row_number() OVER (PARTITION BY dataset ORDER BY n5) AS rank, confidence FROM d WHERE du = 1
    """,
)
def _(spark, sf):
    suggested_rows = [
        ("classification", "lda", 2, None, 1.7), ("classification", "ridge", 1, None, 0.5), ("classification", "nonsense", 1, None, 0.5),
        ("regression", "ridge", 1, None, -0.5), ("regression", "lasso", 2, None, 0.4), ("regression", "ridge", 3, None, 0.9),
        ("regression", "huber", 4, None, 0.3),
    ]
    s = S.small_frame(spark, suggested_rows, "dataset string, id string, rank int, rationale string, confidence double")
    out = shortlist.finalize_picks(s, catalog.algorithm_catalog(spark), suggestion_profiles(spark, sf))
    return out.drop("rationale")
