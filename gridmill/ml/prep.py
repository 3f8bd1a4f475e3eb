"""Checks before training, the feature preprocessor, splits, folds and weights."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import semantics as S
from gridmill.functions.joins import is_small, small_side
from gridmill.functions.pairs import correlations
from gridmill.functions.positions import look_back, with_position
from gridmill.functions.quantiles import column_quantiles
from gridmill.functions.semantics import col
from gridmill.operators import profile
from gridmill.operators.clean import code_table, label_encode
from gridmill.plans.catalog import algorithm
from gridmill.session import pinned

ONE_HOT_LIMIT = 50
CHECKED_COLUMNS = None  # all
LEAK_LIMIT = 0.98
IMBALANCE_LIMIT = 5.0


# --- checks -----------------------------------------------------------------

def target_checks(df: DataFrame, target: str, min_rows: int = 10) -> DataFrame:
    """(level, code, message) findings on the target's presence and size."""
    if target not in df.columns:
        return S.small_frame(
            df.sparkSession, [("error", "no_target", f"Target column '{target}' not found")],
            "level string, code string, message string",
        )
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.count(col(target)).alias("m"))
    n, m = F.col("n"), F.col("m")
    pct = F.round((1 - m / F.greatest(n, F.lit(1))) * 100, 1)
    text = lambda c: c.cast("string")
    checks = [
        (m == 0, "error", "empty_target", F.lit("Target is entirely empty")),
        ((m > 0) & (pct > 80), "error", "mostly_missing", F.concat(F.lit("Target is "), text(pct), F.lit("% missing"))),
        ((pct > 30) & (pct <= 80), "warning", "some_missing", F.concat(F.lit("Target has "), text(pct), F.lit("% missing values"))),
        ((m > 0) & (m < 20), "error", "too_few_rows", F.concat(F.lit("Only "), text(m), F.lit(" rows with a target"))),
        ((m >= 20) & (m < 50), "warning", "few_rows", F.concat(F.lit("Only "), text(m), F.lit(" rows with a target"))),
        ((m >= 20) & (m < min_rows), "error", "algorithm_min_rows", F.concat(F.lit(f"The algorithm needs {min_rows} rows, found "), text(m))),
    ]
    return _fired(facts, checks)


def _fired(facts: DataFrame, checks) -> DataFrame:
    found = F.array_compact(
        F.array(
            *[
                F.when(test, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), message.alias("message")))
                for test, level, code, message in checks
            ]
        )
    )
    return facts.select(F.inline(found))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(label, n) of the non-null classes."""
    return df.filter(col(target).isNotNull()).groupBy(col(target).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def class_checks(df: DataFrame, target: str) -> DataFrame:
    """Findings on the number and size of classes."""
    facts = class_distribution(df, target).agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.min("n"), F.lit(0)).alias("small"))
    k, small = F.col("k"), F.col("small")
    text = lambda c: c.cast("string")
    return _fired(
        facts,
        [
            (k < 2, "error", "one_class", F.concat(F.lit("Only "), text(k), F.lit(" class(es) in the target"))),
            ((k >= 2) & (small < 2), "error", "tiny_class", F.concat(F.lit("Smallest class has "), text(small), F.lit(" row(s)"))),
            ((k >= 2) & (small >= 2) & (small < 5), "warning", "small_class", F.concat(F.lit("Smallest class has "), text(small), F.lit(" rows"))),
            (k > 100, "warning", "many_classes", F.concat(F.lit("Target has "), text(k), F.lit(" classes"))),
        ],
    )


def constant_check(df: DataFrame, target: str) -> DataFrame:
    """One error when a number target does not vary."""
    facts = df.agg(F.min(col(target)).alias("lo"), F.max(col(target)).alias("hi"))
    return _fired(facts, [(F.col("lo") == F.col("hi"), "error", "constant_target", F.lit("Target has zero variance"))])


def leakage_checks(df: DataFrame, target: str) -> DataFrame:
    """A warning for every number column that nearly equals the target."""
    names = [c for c in S.numeric_columns(df) if c != target][:CHECKED_COLUMNS]
    found = np.abs(correlations(df, [*names, target])[:-1, -1])
    rows = [("warning", "leakage", f"Column '{c}' has {r:.3f} correlation with the target") for c, r in zip(names, found) if r > LEAK_LIMIT]
    return S.small_frame(df.sparkSession, rows, "level string, code string, message string")


def id_checks(df: DataFrame, target: str) -> DataFrame:
    """A warning for every column whose values are all different."""
    names = [c for c in df.columns[:CHECKED_COLUMNS] if c != target]
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    unique = profile.distinct_counts(df, names).withColumn("n", n)
    return unique.filter((F.col("n_unique") == F.col("n")) & (F.col("n") > 50)).select(
        F.lit("warning").alias("level"), F.lit("id_like").alias("code"),
        F.concat(F.lit("Column '"), F.col("column"), F.lit("' looks like an ID")).alias("message"),
    )


def validate_training(df: DataFrame, target: str, algo_id: str) -> DataFrame:
    """All findings (level, code, message); training goes on without errors."""
    algo = algorithm(algo_id)
    if algo is None:
        return S.small_frame(
            df.sparkSession, [("error", "no_algorithm", f"Unknown algorithm: '{algo_id}'")],
            "level string, code string, message string",
        )
    out = target_checks(df, target, algo["min_rows"])
    if target not in df.columns:
        return out
    number = S.is_numeric(df, target)
    facts = df.filter(col(target).isNotNull())
    n = facts.count()
    k = profile.distinct_counts(df, [target]).first()["n_unique"] if number else 0
    if not number or (k <= 20 and k / max(n, 1) < 0.05):
        out = out.unionByName(class_checks(df, target))
    else:
        out = out.unionByName(constant_check(df, target))
    if number and len(S.numeric_columns(df)) > 1:
        out = out.unionByName(leakage_checks(df, target))
    return out.unionByName(id_checks(df, target))


# --- preprocessing ----------------------------------------------------------

@dataclass
class Preprocessor:
    """Turns table rows into a ``features`` vector, fitted on training rows only.

    Numbers: median, then standard scale. Text with up to 50 values: most
    frequent, then one column per value (an unseen value is all zeros). Text
    with more values: most frequent, then its sorted code (unseen is -1), looked
    up by a join so that the code table may be of any size.

    Without ``impute``, for models that know missing values, numbers stay as they are and whatever comes from a missing value is NaN.
    """

    numeric: list[str] = field(default_factory=list)
    medians: list[float] = field(default_factory=list)
    means: list[float] = field(default_factory=list)
    deviations: list[float] = field(default_factory=list)
    one_hot: dict[str, list[str]] = field(default_factory=dict)
    ordinal: list[str] = field(default_factory=list)
    modes: dict[str, str] = field(default_factory=dict)
    codes: dict[str, DataFrame] = field(default_factory=dict, repr=False)
    small_codes: dict[str, bool] = field(default_factory=dict)
    impute: bool = True

    @property
    def inputs(self) -> list[str]:
        return [*self.numeric, *self.one_hot, *self.ordinal]

    @property
    def feature_names(self) -> list[str]:
        hot = [f"{c}={v}" for c, values in self.one_hot.items() for v in values]
        return [*self.numeric, *hot, *self.ordinal]

    def spans(self) -> list[tuple[int, int]]:
        """(first place, places) of each input's features in the vector."""
        widths = [len(self.one_hot[c]) if c in self.one_hot else 1 for c in self.inputs]
        return [(sum(widths[:i]), n) for i, n in enumerate(widths)]

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        """``df`` plus the feature vector; columns it lacks count as missing."""
        present = set(df.columns)
        raw = lambda c: col(c) if c in present else F.lit(None)
        out, parts = df, []
        gap = F.lit(float("nan"))
        for c, mid, mu, sd in zip(self.numeric, self.medians, self.means, self.deviations):
            value = S.finite(raw(c).cast("double"))
            parts.append((F.coalesce(value, F.lit(float(mid))) - F.lit(mu)) / F.lit(sd) if self.impute else F.coalesce(value, gap))
        for c, values in self.one_hot.items():
            text = raw(c).cast("string")
            value = F.coalesce(text, F.lit(self.modes.get(c))) if self.impute else text
            hot = [F.when(value == v, 1.0).otherwise(0.0) for v in values]
            parts += hot if self.impute else [F.when(text.isNull(), gap).otherwise(h) for h in hot]
        for i, c in enumerate(self.ordinal):
            table = self.codes[c].select(F.col("value").alias(f"__v{i}"), F.col("code").alias(f"__o{i}"))
            if self.small_codes[c]:
                table = F.broadcast(table)
            text = raw(c).cast("string")
            value = F.coalesce(text, F.lit(self.modes.get(c))) if self.impute else text
            out = out.join(table, value == F.col(f"__v{i}"), "left")
            code = F.coalesce(F.col(f"__o{i}").cast("double"), F.lit(-1.0))
            parts.append(code if self.impute else F.when(text.isNull(), gap).otherwise(code))
        return out.select(*[col(c) for c in df.columns], array_to_vector(F.array(*parts)).alias(output))

    def save(self, spark: SparkSession, path: str) -> None:
        plain = {k: v for k, v in self.__dict__.items() if k != "codes"}
        S.small_frame(spark, [(json.dumps(plain),)], "value string").write.text(f"{path}/preprocessor")
        for i, c in enumerate(self.ordinal):
            self.codes[c].write.parquet(f"{path}/codes_{i}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Preprocessor":
        p = Preprocessor(**json.loads(spark.read.text(f"{path}/preprocessor").first()[0]))
        p.codes = {c: spark.read.parquet(f"{path}/codes_{i}") for i, c in enumerate(p.ordinal)}
        return p


def build_preprocessor(
    train: DataFrame, target: str | None, features: Sequence[str] | None = None, dates: Sequence[str] = (), impute: bool = True
) -> Preprocessor:
    """Fit a ``Preprocessor``; date columns are left out."""
    names = [c for c in (features or train.columns) if c != target and c not in set(dates)]
    p = Preprocessor(numeric=[c for c in names if S.is_numeric(train, c)], impute=impute)
    text = [c for c in names if c in S.text_columns(train) + S.bool_columns(train)]
    if p.numeric:
        found = column_quantiles(train, p.numeric, [0.5])
        p.numeric = [c for c in p.numeric if found[c][0] is not None]
        p.medians = [found[c][0] for c in p.numeric]
    if p.numeric:
        filled = [F.coalesce(S.finite(col(c).cast("double")), F.lit(m)) for c, m in zip(p.numeric, p.medians)]
        row = train.agg(*[f(v).alias(f"a{i}_{f.__name__}") for i, v in enumerate(filled) for f in (F.avg, F.stddev_pop)]).first()
        p.means = [row[2 * i] for i in range(len(filled))]
        p.deviations = [row[2 * i + 1] or 1.0 for i in range(len(filled))]
    if text:
        tops = {r["column"]: r for r in profile.top_values(train, text).collect()}
        p.modes = {c: tops[c]["value"] for c in tops}
        low = [c for c in text if c in tops and tops[c]["n_unique"] <= ONE_HOT_LIMIT]
        p.ordinal = [c for c in text if c in tops and c not in low]
        if low:
            seen = profile.value_counts_long(train, low).select("column", "value").collect()
            p.one_hot = {c: sorted(r["value"] for r in seen if r["column"] == c) for c in low}
        for c in p.ordinal:
            p.codes[c] = code_table(train.filter(col(c).isNotNull()), c)
            p.codes[c] = pinned(p.codes[c])
            p.small_codes[c] = is_small(p.codes[c])
    if not p.inputs:
        raise S.ColumnError("no usable feature columns")
    return p


def legacy_matrix(df: DataFrame, target: str, classification: bool) -> DataFrame:
    """Features as plain columns: label codes for text (a missing value is its
    own label), medians for numbers; text targets as codes."""
    numeric = [c for c in S.numeric_columns(df) if c != target]
    text = [c for c in S.text_columns(df) if c != target]
    middles = column_quantiles(df, numeric, [0.5])
    filled = df.select(
        *[
            F.coalesce(col(c).cast("double"), F.lit(middles[c][0])).alias(c) if c in numeric else col(c)
            for c in df.columns
            if c in numeric or c in text or c == target
        ]
    )
    encode = text + ([target] if classification and target in S.text_columns(df) else [])
    return label_encode(filled, encode)


# --- splits -----------------------------------------------------------------

def _key(df: DataFrame, key: str | Column | None) -> Column:
    if key is None:
        return S.row_digest(df)
    return col(key) if isinstance(key, str) else key


def split(df: DataFrame, frac: float = 0.2, key: str | Column | None = None, seed: int = S.SEED) -> DataFrame:
    """Add ``is_test``: a seeded hash of the row key, independent of layout."""
    return df.withColumn("is_test", S.seeded_bucket(_key(df, key), seed) < int(frac * S.HASH_BUCKETS))


def stratified_split(
    df: DataFrame, label: str, frac: float = 0.2, key: str | Column | None = None, seed: int = S.SEED
) -> DataFrame:
    """Add ``is_test`` with exactly ``round(frac * n)`` test rows per class."""
    k = _key(df, key)
    keyed = df.withColumns({"__key": k, "__hash": S.seeded_hash(k, seed)})
    placed = with_position(keyed, [label], [F.col("__hash").asc(), F.col("__key").asc()], name="__pos")
    sizes = df.groupBy(col(label).alias("__label")).agg(F.round(F.count(F.lit(1)) * F.lit(frac)).alias("__cut"))
    joined = placed.join(small_side(sizes), col(label).eqNullSafe(F.col("__label")))
    return joined.select(*[col(c) for c in df.columns], (F.col("__pos") < F.col("__cut")).alias("is_test"))


def chrono_split(df: DataFrame, date: str, frac: float = 0.2) -> DataFrame:
    """Add ``is_test``: the last share of the time axis."""
    when = F.unix_micros(S.time_col(df, date))
    cut = column_quantiles(df.select(when.alias("u")), ["u"], [1 - frac])["u"][0]
    return df.withColumn("is_test", F.coalesce(when > F.lit(cut), F.lit(False)))


def kfold(df: DataFrame, k: int = 5, key: str | Column | None = None, seed: int = S.SEED, label: str | None = None) -> DataFrame:
    """Add ``fold`` in 0..k-1; with a label, the folds of each class are equal
    in size to within one row."""
    row_key = _key(df, key)
    if label is None:
        return df.withColumn("fold", (S.seeded_bucket(row_key, seed) % k).cast("int"))
    keyed = df.withColumns({"__key": row_key, "__hash": S.seeded_hash(row_key, seed)})
    placed = with_position(keyed, [label], [F.col("__hash").asc(), F.col("__key").asc()], name="__pos")
    return placed.select(*[col(c) for c in df.columns], (F.col("__pos") % k).cast("int").alias("fold"))


def rolling_folds(
    df: DataFrame, date: str, k: int = 5, gap: int = 0, by: Sequence[str] = (), tiebreak: str | None = None
) -> DataFrame:
    """Add ``fold`` and ``ready`` for folds that roll on in time.

    The time axis is cut into k + 1 blocks at its quantiles, and ``fold`` (0..k) is the row's block. Fold i from 1 on tests on block i and trains on
    the rows with ``ready`` <= i: those in blocks before i that have ``gap`` later rows of their series there too, so that no value
    that a test row's lags were made of is a training row's target within that reach. Rows without a time, and the
    last ``gap`` of a series, have a null ``ready``: no fold trains on them. A null time has no block.
    """
    when = F.unix_micros(S.time_col(df, date))
    cuts = column_quantiles(df.select(when.alias("u")), ["u"], [i / (k + 1) for i in range(1, k + 1)])["u"]
    # a time on a cut belongs to the block before it
    block = lambda t: F.when(t.isNotNull(), sum((F.when(t > F.lit(c), 1).otherwise(0) for c in cuts if c is not None), F.lit(0)))
    tie = col(tiebreak) if tiebreak else S.row_digest(df)
    order = [F.col("__when").desc_nulls_first(), tie.desc()]
    timed = df.withColumn("__when", when)
    if gap:
        timed = look_back(timed, by, order, gap, lambda w: {"__after": F.lag("__when", gap).over(w)})
    else:
        timed = timed.withColumn("__after", F.col("__when"))
    new = {"fold": block(F.col("__when")).cast("int"), "ready": (block(F.col("__after")) + 1).cast("int")}
    return timed.withColumns(new).select(*[col(c) for c in df.columns], "fold", "ready")


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(label, n, weight): balanced weights when the classes are uneven, else 1."""
    counts = class_distribution(df, target)
    every = counts.agg(
        F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.max("n").alias("hi"), F.min("n").alias("lo")).alias("t")
    ).scalar()
    with_totals = counts.withColumn("t", every)
    uneven = F.col("t.hi") / F.greatest(F.col("t.lo"), F.lit(1)) > IMBALANCE_LIMIT
    balanced = F.col("t.n") / (F.col("t.k") * F.col("n"))
    return with_totals.select("label", "n", F.when(uneven, balanced).otherwise(1.0).alias("weight"))
