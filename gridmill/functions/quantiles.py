"""Exact quantiles that never gather one column in one task.

One pass over the table counts every column and sketches its distribution (KLL, whose rank error is known), which gives a narrow
bracket around every wanted rank. A second pass counts exactly: a column is cut at the ends of its brackets, rows
in between are only counted, and the values inside a bracket are counted one by one, so the running count tells every
rank. The sketch decides how narrow a bracket is, never the answer: a bracket that misses its rank is opened, and one that still
holds too much is sketched again by itself. Columns of few rows take Spark's exact ``percentile`` in the second pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions.joins import small_side
from gridmill.functions.semantics import col
from gridmill.session import pinned

SMALL_ROWS = 100_000  # rows for the one-task aggregate over whole columns
SMALL_GROUP_ROWS = 1_000_000  # rows of the largest group for the grouped form
SKETCH_SIZE = 8192  # of a KLL sketch
SLACK = 4 * 2.296 / SKETCH_SIZE**0.9021  # four times the rank error that such a sketch keeps to with 99 %
BRACKET_ROWS = 5_000_000  # a bracket expected to hold more is sketched again
GROUP_SKETCH_ACCURACY = 20_000
_MAX_COLUMNS_PER_PASS = 50
_MAX_ROUNDS = 8


@dataclass
class _Bracket:
    """Where one wanted quantile of one column lies."""

    column: int
    place: int  # position of the probability in the caller's list
    rank: float  # 0-based, between two rows when not whole
    total: int
    low: float = -math.inf
    high: float = math.inf
    below: int = 0  # smaller values than ``low``, and values inside; known once the bracket was sketched by itself
    inside: int = 0
    missed: bool = False  # by a sketch; the whole column is looked through then

    @property
    def ranks(self) -> tuple[int, int]:
        return math.floor(self.rank), math.ceil(self.rank)

    @property
    def shares(self) -> tuple[float, float]:
        """The part of the values inside between which the wanted one is looked for."""
        share = (self.rank - self.below) / max(self.inside - 1, 1)
        return max(0.0, share - SLACK), min(1.0, share + SLACK)

    @property
    def expected(self) -> float:
        """Rows thought to lie within ``shares``."""
        low, high = self.shares
        return self.total if self.missed else (high - low) * self.inside

    def reopen(self) -> None:
        self.low, self.high, self.missed = -math.inf, math.inf, True


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    n_rows: int | None = None,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of several columns: ``{column: [q, …]}``, in two passes over the table.

    Only a few numbers per column and probability reach the driver. ``n_rows``, where known, saves nothing but is accepted.
    """
    columns, probs = list(columns), [float(p) for p in probs]
    out: dict[str, list[float | None]] = {}
    for start in range(0, len(columns) if probs else 0, _MAX_COLUMNS_PER_PASS):
        part = columns[start : start + _MAX_COLUMNS_PER_PASS]
        numbers = df.select(*[_number(c).alias(f"v{i}") for i, c in enumerate(part)])
        brackets, largest = _sketched(numbers, probs)
        found = _by_aggregate(numbers, probs) if largest <= SMALL_ROWS else _by_brackets(numbers, probs, brackets)
        out.update(zip(part, found, strict=True))
    return out if probs else {c: [] for c in columns}


def _number(column: str) -> Column:
    """The column as double; NaN counts as missing."""
    number = col(column).cast("double")
    return F.when(~F.isnan(number), number)


def _by_aggregate(numbers: DataFrame, probs: list[float]) -> list[list[float | None]]:
    array = F.array(*[F.lit(p) for p in probs])
    row = numbers.agg(*[F.percentile(c, array).alias(c) for c in numbers.columns]).first()
    return [list(q) if q is not None else [None] * len(probs) for q in row]


def _cuts_of(sketch: Column, shares: Sequence[float]) -> Column:
    return F.when(sketch.isNotNull(), F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(s) for s in shares])))


def _sketched(numbers: DataFrame, probs: list[float]) -> tuple[list[_Bracket], int]:
    """Brackets from one sketch a column, and the rows of the fullest column: the first pass."""
    ends = [e for p in probs for e in (max(0.0, p - SLACK), min(1.0, p + SLACK))]
    summed = numbers.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(numbers.columns)],
        *[F.kll_sketch_agg_double(c, F.lit(SKETCH_SIZE)).alias(f"s{i}") for i, c in enumerate(numbers.columns)],
    )
    row = summed.select(
        *[f"n{i}" for i in range(len(numbers.columns))],
        *[F.when(F.col(f"n{i}") > 0, _cuts_of(F.col(f"s{i}"), ends)).alias(f"c{i}") for i in range(len(numbers.columns))],
    ).first()
    brackets = []
    for i in range(len(numbers.columns)):
        n, cuts = row[f"n{i}"], row[f"c{i}"]
        for j, p in enumerate(probs if n else []):
            brackets.append(_Bracket(i, j, (n - 1) * p, n, cuts[2 * j], cuts[2 * j + 1], 0, n))
    return brackets, max((row[f"n{i}"] for i in range(len(numbers.columns))), default=0)


def _by_brackets(numbers: DataFrame, probs: list[float], todo: list[_Bracket]) -> list[list[float | None]]:
    out: list[list[float | None]] = [[None] * len(probs) for _ in numbers.columns]
    for _ in range(_MAX_ROUNDS):
        if not todo:
            return out
        _narrow(numbers, todo)
        found = _look_up(numbers, todo)
        for b in todo:
            lo, hi = found.get((b.column, b.ranks[0])), found.get((b.column, b.ranks[1]))
            if lo is None or hi is None:
                b.reopen()  # the sketch missed
            else:
                out[b.column][b.place] = lo + (hi - lo) * (b.rank - b.ranks[0])
        todo = [b for b in todo if out[b.column][b.place] is None]
    if todo:
        raise RuntimeError(f"no quantile found for {sorted({numbers.columns[b.column] for b in todo})}")
    return out


def _spans(brackets: list[_Bracket]) -> list[tuple[float, float]]:
    """The brackets of one column, those that overlap as one."""
    spans: list[tuple[float, float]] = []
    for low, high in sorted((b.low, b.high) for b in brackets):
        if spans and low <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(high, spans[-1][1]))
        else:
            spans.append((low, high))
    return spans


def _look_up(numbers: DataFrame, brackets: list[_Bracket]) -> dict[tuple[int, int], float]:
    """``{(column, rank): value}`` for the wanted ranks that lie inside a bracket: the second pass.

    Each value becomes (column, slice, value), with the value itself only inside a bracket, and is counted; tasks
    sum before they shuffle. Odd slices are brackets, even ones lie between them.
    """
    own = {c: [b for b in brackets if b.column == c] for c in sorted({b.column for b in brackets})}
    x, place = F.col("x"), F.lit(None).cast("int")
    for c, mine in own.items():
        here = F.lit(0)
        for low, high in _spans(mine):  # ascending: each end that is reached adds one
            here = here + F.when(x >= F.lit(low), 1).otherwise(0) + F.when(x > F.lit(high), 1).otherwise(0)
        place = F.when(F.col("c") == c, here).otherwise(place)
    # unpivoted first, so that a value is worked out once and only its own column's ends are looked at
    tall = numbers.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(numbers.columns[c]).alias("x")) for c in own]))).filter("x IS NOT NULL")
    placed_in = tall.select("c", place.alias("s"), "x")
    counted = placed_in.groupBy("c", "s", F.when(F.col("s") % 2 == 1, F.col("x")).alias("v")).agg(F.count(F.lit(1)).alias("m"))
    run = Window.partitionBy("c").orderBy("s", "v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("e", F.sum("m").over(run)).withColumn("b", F.col("e") - F.col("m"))
    ranks = [F.lit(c) if k == 0 else F.array(*[F.lit(r).cast("bigint") for r in sorted({r for b in mine for r in b.ranks})]) for c, mine in own.items() for k in (0, 1)]
    wanted = F.try_element_at(F.create_map(*ranks), F.col("c"))
    hits = placed.filter("v IS NOT NULL").select("c", "v", F.explode(F.filter(wanted, lambda r: (r >= F.col("b")) & (r < F.col("e")))).alias("rank"))
    return {(r["c"], r["rank"]): r["v"] for r in hits.collect()}


def _narrow(numbers: DataFrame, brackets: list[_Bracket]) -> None:
    """Sketch by themselves the brackets that are expected to hold very many rows, until they do not or one value fills them."""
    for _ in range(_MAX_ROUNDS):
        wide = [b for b in brackets if b.expected > BRACKET_ROWS and b.low < b.high and not b.missed]
        if not wide:
            return
        aggs = []
        for k, b in enumerate(wide):
            x = F.col(numbers.columns[b.column])
            held = F.when((x >= F.lit(b.low)) & (x <= F.lit(b.high)), x)
            aggs += [F.count_if(x < F.lit(b.low)).alias(f"b{k}"), F.count(held).alias(f"n{k}"), F.kll_sketch_agg_double(held, F.lit(SKETCH_SIZE)).alias(f"s{k}")]
        summed = pinned(numbers.agg(*aggs))
        sizes = summed.first()
        for k, b in enumerate(wide):
            b.below, b.inside = sizes[f"b{k}"], sizes[f"n{k}"]
            if b.ranks[0] < b.below or b.ranks[1] >= b.below + b.inside:
                b.reopen()
        still = [(k, b) for k, b in enumerate(wide) if not b.missed]
        if not still:
            return
        ends = summed.select(*[_cuts_of(F.col(f"s{k}"), b.shares).alias(f"c{k}") for k, b in still]).first()
        moved = False
        for k, b in still:
            low, high = ends[f"c{k}"]
            moved |= (low, high) != (b.low, b.high)
            b.low, b.high = low, high
        if not moved:
            return


def grouped_quantile(df: DataFrame, keys: Sequence[str], value: str, p: float, name: str = "quantile") -> DataFrame:
    """One exact quantile per group, whatever the size of the largest group."""
    return grouped_quantiles(df, keys, value, {name: p})


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Several exact quantiles per group, one column for each name in ``probs``, from one pass over the groups."""
    keys, names = list(keys), list(probs)
    largest = df.groupBy(*[col(k) for k in keys]).agg(F.count(col(value)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= SMALL_GROUP_ROWS:
        wanted = F.array(*[F.lit(float(p)) for p in probs.values()])
        found = df.groupBy(*[col(k) for k in keys]).agg(F.percentile(_number(value), wanted).alias("__q"))
        return found.select(*[col(k) for k in keys], *[F.get("__q", F.lit(i)).alias(n) for i, n in enumerate(names)])
    tall = ranked_quantiles(
        df.select(*[col(k) for k in keys], _number(value).alias("__v")).filter(F.col("__v").isNotNull()),
        keys,
        "__v",
        list(probs.values()),
    )
    found = tall.groupBy(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(
        *[F.max(F.when(F.col("p_index") == i, F.col("quantile"))).alias(n) for i, n in enumerate(names)]
    )
    every = df.select(*[col(k) for k in keys]).distinct()
    same = [col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return every.join(found, same, "left").select(*[col(k) for k in keys], *names)


def ranked_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], few_keys: bool = False
) -> DataFrame:
    """(keys…, p_index, quantile) by counting between sketch cut points.

    ``df`` holds non-null numbers in ``value``. ``few_keys`` states that the
    number of keys is bounded (column names, say), so cuts may be broadcast.
    """
    probs = [float(p) for p in probs]
    slack = 2.0 / GROUP_SKETCH_ACCURACY
    grid = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-slack, slack)})
    cuts = df.groupBy(*[col(k) for k in keys]).agg(
        F.percentile_approx(col(value), F.array(*[F.lit(g) for g in grid]), F.lit(GROUP_SKETCH_ACCURACY)).alias("__cuts"),
        F.count(F.lit(1)).alias("__n"),
    )
    if not few_keys:
        cuts = small_side(pinned(cuts))
    n = F.col("__n").cast("double")
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("p_index"), ((n - 1) * F.lit(p)).alias("pos"))
            for i, p in enumerate(probs)
        ]
    )
    targets = (
        cuts.withColumn("__w", F.explode(wanted))
        .withColumn("__side", F.explode(F.array(F.lit(0), F.lit(1))))
        .select(
            *[col(k) for k in keys],
            F.col("__w.p_index").alias("p_index"),
            F.col("__side"),
            (F.col("__w.pos") - F.floor("__w.pos")).alias("__frac"),
            F.when(F.col("__side") == 0, F.floor("__w.pos")).otherwise(F.ceil("__w.pos")).cast("bigint").alias("__rank"),
        )
    )
    values = order_statistics(df, keys, value, cuts.select(*[col(k) for k in keys], "__cuts"), targets, few_keys)
    low = F.max(F.when(F.col("__side") == 0, F.col("__value")))
    high = F.max(F.when(F.col("__side") == 1, F.col("__value")))
    return (
        values.groupBy(*[col(k) for k in keys], "p_index")
        .agg(low.alias("__lo"), high.alias("__hi"), F.max("__frac").alias("__f"))
        .select(
            *[col(k) for k in keys],
            "p_index",
            (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__f")).alias("quantile"),
        )
    )


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, cuts: DataFrame, targets: DataFrame, few_keys: bool = False
) -> DataFrame:
    """Attach to each (keys…, __rank) target the value at that 0-based rank.

    ``cuts`` gives per key an ascending array ``__cuts``. Rows are counted per
    slice first (partial sums, one small row per key and slice); only slices
    that hold a wanted rank are then sorted, as (value, count) pairs.
    """
    keys = list(keys)
    key_cols = [col(k) for k in keys]
    bounds = cuts.select(*[col(k).alias(f"__c{i}") for i, k in enumerate(keys)], "__cuts")
    if few_keys:
        bounds = F.broadcast(bounds)
    same_key = [col(k).eqNullSafe(F.col(f"__c{i}")) for i, k in enumerate(keys)]
    sliced = (
        df.join(bounds, same_key, "inner")
        .select(
            *key_cols,
            col(value).alias("__v"),
            F.size(F.filter("__cuts", lambda b: b <= col(value))).alias("__slice"),
        )
    )
    counted = sliced.groupBy(*key_cols, "__slice").agg(F.count(F.lit(1)).alias("__in"))
    upto = Window.partitionBy(*key_cols).orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)
    spans = counted.withColumn("__end", F.sum("__in").over(upto)).withColumn("__start", F.col("__end") - F.col("__in"))
    t = targets.select(
        *[col(k).alias(f"__t{i}") for i, k in enumerate(keys)], *[c for c in targets.columns if c not in keys]
    )
    same_t = [col(k).eqNullSafe(F.col(f"__t{i}")) for i, k in enumerate(keys)]
    placed = (
        spans.join(t, same_t, "inner")
        .filter((F.col("__rank") >= F.col("__start")) & (F.col("__rank") < F.col("__end")))
        .withColumn("__local", F.col("__rank") - F.col("__start"))
        .select(
            *[col(k) for k in keys],
            "__slice",
            "__local",
            *[c for c in targets.columns if c not in keys],
        )
    )
    need = placed.select(*[col(k).alias(f"__n{i}") for i, k in enumerate(keys)], F.col("__slice").alias("__ns")).distinct()
    if few_keys:
        need = F.broadcast(need)
    in_need = [col(k).eqNullSafe(F.col(f"__n{i}")) for i, k in enumerate(keys)] + [F.col("__slice") == F.col("__ns")]
    pairs = (
        sliced.join(need, in_need, "left_semi")
        .groupBy(*key_cols, "__slice", "__v")
        .agg(F.count(F.lit(1)).alias("__m"))
    )
    run = Window.partitionBy(*key_cols, "__slice").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    sorted_pairs = pairs.withColumn("__e", F.sum("__m").over(run)).withColumn("__s", F.col("__e") - F.col("__m"))
    p = placed.select(
        *[col(k).alias(f"__p{i}") for i, k in enumerate(keys)],
        F.col("__slice").alias("__ps"),
        "__local",
        *[c for c in targets.columns if c not in keys],
    )
    same_p = [col(k).eqNullSafe(F.col(f"__p{i}")) for i, k in enumerate(keys)] + [F.col("__slice") == F.col("__ps")]
    return (
        sorted_pairs.join(p, same_p, "inner")
        .filter((F.col("__local") >= F.col("__s")) & (F.col("__local") < F.col("__e")))
        .select(*key_cols, *[c for c in targets.columns if c not in keys], F.col("__v").alias("__value"))
    )


def value_at_rank(df: DataFrame, value: str, rank: int, n_rows: int) -> float | int | None:
    """The value at a 0-based rank of one numeric column, on the full data."""
    if rank < 0 or rank >= n_rows:
        return None
    p = rank / max(n_rows - 1, 1)
    slack = 2.0 / GROUP_SKETCH_ACCURACY
    tall = df.select(F.lit(0).alias("__one"), col(value).alias("__x")).filter(F.col("__x").isNotNull())
    cuts = tall.groupBy("__one").agg(
        F.percentile_approx(
            "__x", F.array(F.lit(max(0.0, p - slack)), F.lit(min(1.0, p + slack))), F.lit(GROUP_SKETCH_ACCURACY)
        ).alias("__cuts")
    )
    target = cuts.select("__one", F.lit(rank).cast("bigint").alias("__rank"))
    row = order_statistics(tall, ["__one"], "__x", cuts, target, few_keys=True).first()
    return row["__value"] if row else None
