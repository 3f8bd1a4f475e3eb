"""Rule-based findings, for one table or for every segment of it in one job.

Both forms fill the same row of facts per segment; the messages are column
expressions over those facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions import semantics as S
from gridmill.functions.joins import small_side
from gridmill.functions.positions import with_position
from gridmill.functions.quantiles import column_quantiles, grouped_quantiles
from gridmill.functions.semantics import col
from gridmill.operators import kpi
from gridmill.operators.profile import IQR_FENCE, outside

MISSING_LIMIT, LARGE_ROWS, CORR_LIMIT = 5.0, 100_000, 0.5


def table_facts(df: DataFrame, roles: dict[str, str], segment: str = "all", tiebreak: str | None = None) -> DataFrame:
    """One row of facts for the whole table."""
    value, date, cat = roles.get("value"), roles.get("date"), roles.get("category")
    none = F.lit(None).cast("double")
    missing = sum((S.count_missing(col(c)) for c in df.columns), F.lit(0))
    n = F.count(F.lit(1))
    aggs = {"n_rows": n, "missing_pct": F.round(F.try_divide(missing, n * len(df.columns)) * 100, 1)}
    if value:
        q1, q3 = column_quantiles(df, [value], [0.25, 0.75])[value]
        aggs["n_value"] = F.count(col(value))
        aggs["outliers"] = F.count(F.when(outside(col(value), q1, q3), 1))
        aggs["best_corr"] = _best_corr(df, value)
    facts = df.agg(*[a.alias(k) for k, a in aggs.items()])
    if not value:
        facts = facts.withColumns({"n_value": F.lit(0).cast("bigint"), "outliers": F.lit(0).cast("bigint")})
        facts = facts.withColumn("best_corr", F.lit(None).cast("struct<r:double,column:string>"))
    growth = kpi.period_growth(df, date, value, tiebreak).select("growth_pct").scalar() if value and date else none
    top = _top_share(df, [], cat, value).scalar() if value and cat else F.lit(None).cast("struct<label:string,pct:double>")
    return facts.withColumns({"segment": F.lit(segment), "growth": growth, "top": top})


def segment_facts(df: DataFrame, by: str, roles: dict[str, str], tiebreak: str | None = None) -> DataFrame:
    """One row of facts per value of ``by``, from grouped aggregations."""
    value, date, cat = roles["value"], roles.get("date"), roles.get("category")
    key = S.label_of(col(by))
    seg = df.withColumn("segment", key)
    missing = sum((S.count_missing(col(c)) for c in df.columns), F.lit(0))
    n = F.count(F.lit(1))
    facts = seg.groupBy("segment").agg(
        n.alias("n_rows"),
        F.round(F.try_divide(missing, n * len(df.columns)) * 100, 1).alias("missing_pct"),
        F.count(col(value)).alias("n_value"),
        _best_corr(df, value).alias("best_corr"),
    )
    fences = small_side(grouped_quantiles(seg, ["segment"], value, {"q1": 0.25, "q3": 0.75}))
    spread = IQR_FENCE * (F.col("q3") - F.col("q1"))
    v = col(value).cast("double")
    beyond = (v < F.col("q1") - spread) | (v > F.col("q3") + spread)
    outliers = seg.select("segment", col(value)).join(fences, "segment").groupBy("segment").agg(
        F.count(F.when(beyond, 1)).alias("outliers")
    )
    out = facts.join(outliers, "segment", "left")
    if cat and cat != by:
        out = out.join(_top_share(seg, ["segment"], cat, value), "segment", "left")
    else:
        out = out.withColumn("top", F.lit(None).cast("struct<label:string,pct:double>"))
    if date:
        out = out.join(_segment_growth(seg, date, value, tiebreak), "segment", "left")
    else:
        out = out.withColumn("growth", F.lit(None).cast("double"))
    return out


def _best_corr(df: DataFrame, value: str) -> Column:
    """The number column that moves most with ``value``: struct(r, column)."""
    others = [c for c in S.numeric_columns(df) if c != value]
    if not others:
        return F.max(F.lit(None).cast("struct<r:double,column:string>"))
    pairs = [
        F.struct(F.abs(S.pearson(col(c), col(value))).alias("r"), F.lit(c).alias("column")) for c in others
    ]
    known = F.filter(F.array(*pairs), lambda p: p["r"].isNotNull())
    # largest r; the earlier column wins a tie
    return F.reduce(
        known, F.lit(None).cast("struct<r:double,column:string>"),
        lambda best, p: F.when(best.isNull() | (p["r"] > best["r"]), p).otherwise(best),
    )


def _top_share(df: DataFrame, keys: list[str], cat: str, value: str) -> DataFrame:
    """(keys…, top): the category with the largest sum and its share in percent."""
    grouped = kpi.aggregate(df.filter(col(cat).isNotNull()), [*keys, cat], value)
    label = col(cat).cast("string")
    best = F.min_by(
        F.struct(label.alias("label"), F.col("value").alias("v")),
        F.struct((-F.col("value")).alias("v"), label.alias("label")),
    )
    agg = [best.alias("b"), F.sum("value").alias("s")]
    total = grouped.groupBy(*keys).agg(*agg) if keys else grouped.agg(*agg)
    top = F.struct(F.col("b.label").alias("label"), F.round(F.try_divide(F.col("b.v"), F.col("s")) * 100, 1).alias("pct"))
    return total.select(*keys, top.alias("top"))


def _segment_growth(seg: DataFrame, date: str, value: str, tiebreak: str | None) -> DataFrame:
    """(segment, growth): change from the first to the second half of each segment."""
    flat = seg.select(
        "segment", S.time_col(seg, date).alias("d"), col(value).alias("v"),
        (col(tiebreak) if tiebreak else S.row_digest(seg)).alias("t"),
    ).filter(F.col("d").isNotNull())
    placed = with_position(flat, ["segment"], [F.col("d").asc(), F.col("t").asc()])
    sizes = flat.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    first = F.col("pos") < F.floor(F.col("n") / 2)
    halves = placed.join(small_side(sizes), "segment").groupBy("segment").agg(
        S.total(F.when(first, F.col("v"))).alias("a"), S.total(F.when(~first, F.col("v"))).alias("b")
    )
    return halves.select(
        "segment", F.when(F.col("a") > 0, F.round((F.col("b") - F.col("a")) / F.col("a") * 100, 2)).alias("growth")
    )


def _finding(condition: Column, kind: str, title: Column, body: Column, severity: Column) -> Column:
    return F.when(
        condition,
        F.struct(F.lit(kind).alias("type"), title.alias("title"), body.alias("body"), severity.alias("severity")),
    )


def insight_rows(facts: DataFrame, value: str | None, large_rows: int = LARGE_ROWS) -> DataFrame:
    """(segment, type, title, body, severity) for every rule that fires."""
    name = F.lit(value or "")
    g = F.col("growth")
    up = g > 0
    r1 = F.round("best_corr.r", 3)
    outlier_pct = F.round(F.try_divide(F.col("outliers"), F.col("n_value")) * 100, 1)
    text = lambda c: c.cast("string")
    findings = F.array_compact(
        F.array(
            _finding(
                g.isNotNull(), "trend",
                F.concat(F.when(up, "Positive").otherwise("Negative"), F.lit(" Growth Detected")),
                F.concat(
                    name, F.lit(" has "), F.when(up, "increased").otherwise("decreased"), F.lit(" by "),
                    F.format_string("%.1f", F.round(F.abs(g), 1)),
                    F.lit("% comparing the first and second half of the dataset."),
                ),
                F.when(up, "success").otherwise("warning"),
            ),
            _finding(
                F.col("top.label").isNotNull(), "top_performer",
                F.concat(F.lit("Top Performer: "), F.col("top.label")),
                F.concat(
                    F.lit("'"), F.col("top.label"), F.lit("' accounts for "), text(F.col("top.pct")),
                    F.lit("% of total "), name, F.lit("."),
                ),
                F.lit("info"),
            ),
            _finding(
                F.col("missing_pct") > MISSING_LIMIT, "quality",
                F.concat(text(F.col("missing_pct")), F.lit("% Missing Data Detected")),
                F.concat(F.lit("The dataset has "), text(F.col("missing_pct")), F.lit("% missing values.")),
                F.lit("warning"),
            ),
            _finding(
                F.col("outliers") > 0, "anomaly",
                F.concat(text(F.col("outliers")), F.lit(" Outliers in "), name),
                F.concat(
                    F.lit("Found "), text(F.col("outliers")), F.lit(" statistical outliers ("), text(outlier_pct),
                    F.lit("% of data)."),
                ),
                F.lit("warning"),
            ),
            _finding(
                F.col("n_rows") > large_rows, "scale", F.lit("Large Dataset"),
                F.concat(F.lit("Dataset has "), F.format_number("n_rows", 0), F.lit(" rows.")), F.lit("info"),
            ),
            _finding(
                r1 > CORR_LIMIT, "correlation", F.lit("Strong Correlation Found"),
                F.concat(
                    F.lit("'"), F.col("best_corr.column"), F.lit("' has a "), F.format_string("%.2f", F.round(r1, 2)),
                    F.lit(" correlation with '"), name, F.lit("'."),
                ),
                F.lit("success"),
            ),
        )
    )
    return facts.select("segment", F.inline(findings))


def insights(
    df: DataFrame,
    roles: dict[str, str] | None = None,
    tiebreak: str | None = None,
    by: str | None = None,
    large_rows: int = LARGE_ROWS,
) -> DataFrame:
    """Findings for the table, or per segment when ``by`` is given."""
    from gridmill.operators.typing import detect_kpi_roles

    roles = detect_kpi_roles(df) if roles is None else roles
    facts = segment_facts(df, by, roles, tiebreak) if by else table_facts(df, roles, tiebreak=tiebreak)
    return insight_rows(facts, roles.get("value"), large_rows)
