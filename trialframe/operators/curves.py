"""Growth curves fitted by Gauss-Newton as Spark aggregations.

Every round is one ``groupBy(fit keys).agg`` over the cell table: J'J, J'r and
the residual sum of squares at the trial parameters, weighted by cell size.
The state (one row per fit) stays a DataFrame; lineage is cut with a reliable
checkpoint every few rounds and only the number of unfinished fits reaches the
driver. All fits, however many, share the rounds; finished ones leave the loop.

Step control is the usual halving: a trial that does not lower the residual
sum of squares is retried with half the step. A fit that cannot go on gets
NULL parameters and never stops the job.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from trialframe.functions.probability import chi2_upper, f_upper, t_quantile, t_two_sided
from trialframe.session import broadcast_if_small, fits_broadcast, materialize


@dataclass(frozen=True)
class Curve:
    """A mean function: parameter names, and value with gradient as columns."""

    name: str
    params: tuple[str, ...]
    terms: Callable[[Column, Mapping[str, Column]], tuple[Column, list[Column]]]

    def value(self, x: Column, p: Mapping[str, Column]) -> Column:
        return self.terms(x, p)[0]


def _sigmoid(x: Column, p: Mapping[str, Column]) -> tuple[Column, Column]:
    """Share of the way up, and the scaled distance to the midpoint."""
    z = F.try_divide(x - p["xmid"], p["scal"])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), z


def _logistic(x, p):
    s, z = _sigmoid(x, p)
    steep = F.try_divide(p["asym"] * s * (F.lit(1.0) - s), p["scal"])
    return p["asym"] * s, [s, -steep, -steep * z]


def _logistic_offset(x, p):
    value, gradient = _logistic(x, p)
    return value + p["offset"], [*gradient, F.lit(1.0)]


def _asymptotic(x, p):
    rate = F.exp(p["lrc"])
    left = F.exp(-rate * (x - p["c0"]))
    return (
        p["asym"] * (F.lit(1.0) - left),
        [F.lit(1.0) - left, p["asym"] * left * rate * (x - p["c0"]), -p["asym"] * left * rate],
    )


def _broken_line(x, p):
    past = F.when(x > p["break"], x - p["break"]).otherwise(0.0)
    step = F.when(x > p["break"], -p["turn"]).otherwise(0.0)
    return p["start"] + p["slope"] * x + p["turn"] * past, [F.lit(1.0), x, past, step]


LOGISTIC = Curve("logistic", ("asym", "xmid", "scal"), _logistic)
LOGISTIC_OFFSET = Curve("logistic_offset", ("asym", "xmid", "scal", "offset"), _logistic_offset)
ASYMPTOTIC = Curve("asymptotic", ("asym", "lrc", "c0"), _asymptotic)
BROKEN_LINE = Curve("broken_line", ("start", "slope", "turn", "break"), _broken_line)


def shared_logistic(levels: Sequence[str], treatment: str = "treatment") -> Curve:
    """Logistic with an own asymptote per stated level and common xmid and scal."""
    own = tuple(f"asym_{level}" for level in levels)

    def terms(x, p):
        s, z = _sigmoid(x, p)
        is_level = [F.col(treatment) == F.lit(level) for level in levels]
        asym = reduce(
            lambda rest, pair: F.when(pair[0], p[pair[1]]).otherwise(rest),
            list(zip(is_level, own)),
            F.lit(None).cast("double"),
        )
        steep = F.try_divide(asym * s * (F.lit(1.0) - s), p["scal"])
        return asym * s, [
            *(F.when(hit, s).otherwise(0.0) for hit in is_level),
            -steep,
            -steep * z,
        ]

    return Curve("shared_logistic", (*own, "xmid", "scal"), terms)


_VECTOR = ArrayType(DoubleType())
_STATE = (
    StructType()
    .add("trial", _VECTOR)
    .add("best", _VECTOR)
    .add("delta", _VECTOR)
    .add("step", DoubleType())
    .add("best_rss", DoubleType())
    .add("unit_cov", _VECTOR)
    .add("n", LongType())
    .add("rounds", IntegerType())
    .add("done", BooleanType())
    .add("converged", BooleanType())
)


def _solve_batch(gram: np.ndarray, right: np.ndarray):
    """Solutions and inverses of one small symmetric system per row, and which could be solved."""
    size = right.shape[1]
    row, column = np.triu_indices(size)
    full = np.empty((len(gram), size, size))
    full[:, row, column] = gram
    full[:, column, row] = gram
    with np.errstate(all="ignore"):
        scale = np.sqrt(np.diagonal(full, axis1=1, axis2=2))
        usable = np.isfinite(full).all(axis=(1, 2)) & (scale > 0).all(axis=1)
    scale = np.where(usable[:, None], scale, 1.0)
    outer = scale[:, :, None] * scale[:, None, :]
    unit = np.where(usable[:, None, None], full, np.eye(size)) / outer
    solved = usable & (np.linalg.eigvalsh(unit)[:, 0] >= 1e-13)
    inverse = np.linalg.inv(np.where(solved[:, None, None], unit, np.eye(size)))
    right = np.where(solved[:, None], right, 0.0)
    delta = np.einsum("bij,bj->bi", inverse, right / scale) / scale
    return delta, (inverse / outer).reshape(len(gram), -1), solved


def _advance(tolerance: float, smallest_step: float):
    """One Gauss-Newton decision per fit, for a whole Arrow batch of states at once."""

    def stack(column: pd.Series) -> np.ndarray:
        return np.array(column.tolist(), dtype=float)

    @F.pandas_udf(_STATE)
    def run(pack: pd.DataFrame) -> pd.DataFrame:
        trial, best, delta = (stack(pack[c]) for c in ("trial", "best", "delta"))
        cov, gram, right = (stack(pack[c]) for c in ("unit_cov", "gram", "right"))
        step, best_rss = (pack[c].to_numpy(float, copy=True) for c in ("step", "best_rss"))
        done, converged = (pack[c].to_numpy(bool, copy=True) for c in ("done", "converged"))
        rss = np.where(pack["complete"].to_numpy(bool), pack["rss"].to_numpy(float), np.nan)

        new_delta, new_cov, solved = _solve_batch(gram, right)
        # near the minimum the residual no longer resolves a step: allow its rounding error;
        # a place where the curve is flat in some parameter is no progress either
        with np.errstate(invalid="ignore"):
            better = np.isfinite(rss) & (rss <= best_rss * (1 + 1e-10)) & solved
        accept, refuse = better & ~done, ~better & ~done
        pick = accept[:, None]
        best, delta = np.where(pick, trial, best), np.where(pick, new_delta, delta)
        cov, step = np.where(pick, new_cov, cov), np.where(accept, np.minimum(1, 2 * step), step)
        best_rss = np.where(accept, rss, best_rss)

        arrived = accept & (np.abs(delta) <= tolerance * (np.abs(trial) + tolerance)).all(axis=1)
        # the last, negligible step costs nothing and removes most of its own size in error
        best = np.where(arrived[:, None], trial + delta, best)
        hopeless = refuse & np.isinf(best_rss)
        step = np.where(refuse, step / 2, step)
        # no smaller residual along the step: a minimum to working precision
        stalled = refuse & ~hopeless & (step < smallest_step)
        near = (np.abs(delta) <= 1e-4 * (np.abs(best) + 1e-4)).all(axis=1)
        rounds = pack["rounds"].to_numpy(int) + ~done
        converged |= arrived | (stalled & near)
        done |= arrived | hopeless | stalled
        trial = np.where(done[:, None], trial, best + step[:, None] * delta)
        return pd.DataFrame(
            {
                "trial": list(trial),
                "best": list(best),
                "delta": list(delta),
                "step": step,
                "best_rss": best_rss,
                "unit_cov": list(cov),
                "n": pack["n"],
                "rounds": rounds,
                "done": done,
                "converged": converged,
            }
        )

    return run


def _round(curve: Curve, keys: list[str], advance) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """One round as a function of (cells, state); its expressions are built once."""
    p = {name: F.col("state.trial").getItem(i) for i, name in enumerate(curve.params)}
    size = len(curve.params)
    value, gradient = curve.terms(F.col("x").cast("double"), p)
    inputs = [
        *keys,
        "state",
        "n",
        "ss",
        (F.col("mean") - value).alias("_r"),
        *(g.alias(f"_j{i}") for i, g in enumerate(gradient)),
    ]
    n, r = F.col("n").cast("double"), F.col("_r")
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    sums = [
        F.sum("n").alias("n"),
        F.sum(n * r * r + F.col("ss")).alias("rss"),
        (F.count("_r") == F.count(F.lit(1))).alias("complete"),
        *(F.sum(n * F.col(f"_j{i}") * F.col(f"_j{j}")).alias(f"_g{i}_{j}") for i, j in upper),
        *(F.sum(n * F.col(f"_j{i}") * r).alias(f"_b{i}") for i in range(size)),
    ]
    number = lambda c: F.coalesce(c, F.lit(float("nan")))
    carried = [c for c in _STATE.names if c != "n"]
    pack = F.struct(
        *(F.col(f"state.{c}").alias(c) for c in carried),
        "n",
        number("rss").alias("rss"),
        "complete",
        F.array(*(number(f"_g{i}_{j}") for i, j in upper)).alias("gram"),
        F.array(*(number(f"_b{i}") for i in range(size))).alias("right"),
    )
    outputs = [*keys, advance(pack).alias("state")]

    def run(cells: DataFrame, state: DataFrame, few: bool) -> DataFrame:
        rows = cells.join(F.broadcast(state) if few else state, keys)
        # the state is one value per fit: as a grouping column it costs no sort
        return rows.select(*inputs).groupBy(*keys, "state").agg(*sums).select(*outputs)

    return run


def fit_curve(
    cells: DataFrame,
    curve: Curve,
    starts: DataFrame | Mapping[str, float],
    keys: Sequence[str] = ("family", "treatment"),
    tolerance: float = 1e-10,
    max_rounds: int = 60,
    rounds_per_checkpoint: int = 4,
    written: bool = False,
) -> DataFrame:
    """One row for each key of the cells: parameters, rss, n, unscaled covariance, convergence.

    ``starts`` is a table keyed by ``keys`` with one column per parameter, or
    literal values used for every fit. ``cells`` gives x, n, mean, ss; within
    cell sums of squares are part of the residual, so the fit is that of the
    raw rows. Pass ``written`` if the cells are a checkpoint already. Eager: runs
    the rounds.

    ``status`` is ``converged``, ``no start`` (a start value is missing),
    ``stalled`` (no step improves the fit) or ``rounds used up``; all but the
    first leave the parameters NULL.
    """
    keys = list(keys)
    if not written:
        cells = materialize(
            cells.select(*dict.fromkeys([*keys, *(["treatment"] if "treatment" in cells.columns else []), "x", "n", "mean", "ss"]))
        )
    table = cells.select(*keys).distinct()
    if isinstance(starts, DataFrame):
        starts = materialize(table.join(starts, keys, "left"))
    else:
        starts = table.select(*keys, *(F.lit(float(starts[p])).alias(p) for p in curve.params))
    given = starts.select(*keys, reduce(Column.__and__, [F.col(p).isNotNull() for p in curve.params]).alias("_given"))
    size = len(curve.params)
    trial = F.array(*(F.coalesce(F.col(p).cast("double"), F.lit(float("nan"))) for p in curve.params))
    zeros = lambda length: F.array(*(F.lit(0.0) for _ in range(length)))
    state = starts.select(
        *keys,
        F.struct(
            trial.alias("trial"),
            trial.alias("best"),
            zeros(size).alias("delta"),
            F.lit(1.0).alias("step"),
            F.lit(float("inf")).alias("best_rss"),
            zeros(size * size).alias("unit_cov"),
            F.lit(0).alias("n"),
            F.lit(0).alias("rounds"),
            F.lit(False).alias("done"),
            F.lit(False).alias("converged"),
        )
        .cast(_STATE)
        .alias("state"),
    )
    state = materialize(state)
    # the state is sent to every task only while its counted size is within bounds
    few = fits_broadcast(state.count(), 400 + 16 * len(curve.params) ** 2)
    one_round = _round(curve, keys, _advance(tolerance, 2.0**-20))
    finished: list[DataFrame] = []
    rounds = 0
    while rounds < max_rounds:
        live = state
        for _ in range(rounds_per_checkpoint):
            live = one_round(cells, live, few)
            rounds += 1
        state = materialize(live)
        done, left = state.agg(
            F.count_if("state.done"), F.count_if(~F.col("state.done"))
        ).first()
        if done:
            finished.append(state.where("state.done"))
            state = state.where("not state.done")
        if not left:
            break
    everything = reduce(DataFrame.unionByName, [*finished, state]).join(given, keys)
    good = F.col("state.converged")
    status = (
        F.when(~F.col("_given"), "no start")
        .when(good, "converged")
        .when(F.col("state.done"), "stalled")
        .otherwise("rounds used up")
    )
    return everything.select(
        *keys,
        *(
            F.when(good, F.col("state.best").getItem(i)).alias(name)
            for i, name in enumerate(curve.params)
        ),
        F.when(good, F.col("state.best_rss")).alias("rss"),
        F.col("state.n").alias("n"),
        F.lit(len(curve.params)).cast("long").alias("parameters"),
        F.when(good, F.col("state.unit_cov")).alias("unit_cov"),
        F.col("state.rounds").alias("rounds"),
        F.coalesce(good, F.lit(False)).alias("converged"),
        status.alias("status"),
    )


def logistic_starts(cells: DataFrame, keys: Sequence[str] = ("family", "treatment")) -> DataFrame:
    """Start values of the logistic from the data.

    Means per x are scaled into (0, 1), x is regressed on their logit (midpoint
    and scale), and the asymptote is the least-squares multiplier of that shape.
    """
    keys = list(keys)
    points = cells.groupBy(*keys, "x").agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_y"), F.sum("n").alias("_n")
    )
    span = points.groupBy(*keys).agg(F.min("_y").alias("_lo"), F.max("_y").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    share = F.try_divide(F.col("_y") - F.col("_lo") + width * 0.05, width * 1.1)
    scaled = points.join(span, keys).select(
        *keys,
        F.col("x").cast("double").alias("x"),
        "_y",
        "_n",
        F.ln(F.try_divide(share, F.lit(1.0) - share)).alias("_z"),
    )
    shape = scaled.groupBy(*keys).agg(
        F.regr_intercept("x", "_z").alias("xmid"), F.regr_slope("x", "_z").alias("scal")
    )
    height, _ = _sigmoid(F.col("x"), {"xmid": F.col("xmid"), "scal": F.col("scal")})
    asym = (
        scaled.join(shape, keys)
        .withColumn("_s", height)
        .groupBy(*keys)
        .agg(
            F.try_divide(
                F.sum(F.col("_n") * F.col("_s") * F.col("_y")),
                F.sum(F.col("_n") * F.col("_s") * F.col("_s")),
            ).alias("asym")
        )
    )
    return asym.join(shape, keys).select(*keys, "asym", "xmid", "scal")


def logistic_offset_starts(cells: DataFrame, keys: Sequence[str] = ("family", "treatment")) -> DataFrame:
    """Start values of the logistic with an offset: the shape of ``logistic_starts``, height and offset as the line of y on it."""
    keys = list(keys)
    shape = logistic_starts(cells, keys).drop("asym")
    s, _ = _sigmoid(F.col("x").cast("double"), {"xmid": F.col("xmid"), "scal": F.col("scal")})
    points = cells.select(*keys, "x", "n", "mean").join(shape, keys).withColumn("_s", s)
    return _weighted_lines(points.withColumn("x", F.col("_s")), [*keys, "xmid", "scal"]).select(
        *keys, F.col("slope").alias("asym"), "xmid", "scal", F.col("intercept").alias("offset")
    )


def asymptotic_starts(
    cells: DataFrame, keys: Sequence[str] = ("family", "treatment"), steps: int = 32, rounds: int = 3
) -> DataFrame:
    """Start values of the asymptotic curve by separable least squares.

    For a given rate r the curve is a line in w = (1 - exp(-r (x - x0))) / (1 - exp(-r S)), x0
    being the least x and S the span, so that height and offset follow from sums of one pass.
    A grid of rates, evenly spaced on the logarithm from a fiftieth to the five hundredfold of
    1/S, is refined around its best one, each time to a grid between the neighbours. A key with
    fewer than three x, or whose best line has no such curve, has NULL starts.
    """
    keys = list(keys)
    points = cells.groupBy(*keys, "x").agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_y"), F.sum("n").cast("double").alias("_n")
    )
    span = points.groupBy(*keys).agg(
        F.min("x").cast("double").alias("_x0"),
        (F.max("x") - F.min("x")).cast("double").alias("_span"),
        (F.sum(F.col("_n") * F.col("_y")) / F.sum("_n")).alias("_m"),
        F.count(F.lit(1)).alias("_points"),
    )
    points = materialize(
        points.join(span.where((F.col("_points") >= 3) & (F.col("_span") > 0)), keys).select(
            *keys, (F.col("x").cast("double") - F.col("_x0")).alias("_d"), "_span", (F.col("_y") - F.col("_m")).alias("_e"), "_n", "_x0", "_m"
        )
    )
    low, high = float(np.log(0.02)), float(np.log(500.0))
    middle, reach = F.lit((low + high) / 2), (high - low) / 2
    best = None
    for _ in range(rounds):
        grid = F.transform(F.sequence(F.lit(-steps), F.lit(steps)), lambda k: F.col("_mid") + k * F.lit(reach / steps))
        rows = points.withColumn("_mid", middle) if best is None else points.join(best.select(*keys, F.col("_u").alias("_mid")), keys)
        rows = rows.withColumn("_u", F.explode(grid)).withColumn("_r", F.exp("_u") / F.col("_span"))
        top = -F.expm1(-F.col("_r") * F.col("_span"))
        rows = rows.withColumn("_w", F.try_divide(-F.expm1(-F.col("_r") * F.col("_d")), top))
        n, w, e = F.col("_n"), F.col("_w"), F.col("_e")
        sums = rows.groupBy(*keys, "_u").agg(
            F.sum(n).alias("_n"),
            (F.sum(n * w) / F.sum(n)).alias("_mw"),
            F.sum(n * w * w).alias("_ww"),
            F.sum(n * w * e).alias("_we"),
            F.sum(n * e * e).alias("_ee"),
            *(F.first(c).alias(c) for c in ("_r", "_span", "_x0", "_m")),
        )
        sww = F.col("_ww") - F.col("_n") * F.col("_mw") * F.col("_mw")
        slope = F.try_divide(F.col("_we"), F.when(sww > 0, sww))
        fitted = sums.withColumn("_b", slope).withColumn("_rss", F.col("_ee") - F.col("_b") * F.col("_we")).where(F.col("_rss").isNotNull())
        best = materialize(
            fitted.groupBy(*keys).agg(F.min(F.struct("_rss", "_u", "_b", "_mw", "_r", "_span", "_x0", "_m")).alias("_s")).select(*keys, "_s.*")
        )
        reach = reach / steps
    start = F.col("_m") - F.col("_b") * F.col("_mw")  # the curve at x0
    asym = start + F.try_divide(F.col("_b"), -F.expm1(-F.col("_r") * F.col("_span")))
    left = F.lit(1.0) - F.try_divide(F.col("_a"), F.col("asym"))
    found = best.withColumn("_a", start).withColumn("asym", asym).withColumn("_left", left)
    found = found.select(
        *keys,
        F.when(F.col("_left") > 0, F.col("asym")).alias("asym"),
        F.when(F.col("_left") > 0, F.ln("_r")).alias("lrc"),
        F.when(F.col("_left") > 0, F.col("_x0") + F.ln("_left") / F.col("_r")).alias("c0"),
    )
    return cells.select(*keys).distinct().join(found, keys, "left")


def curve_starts(cells: DataFrame, curve: Curve, keys: Sequence[str] = ("family", "treatment")) -> DataFrame:
    """Start values of a curve that can find its own."""
    known = {
        LOGISTIC.name: logistic_starts,
        LOGISTIC_OFFSET.name: logistic_offset_starts,
        ASYMPTOTIC.name: asymptotic_starts,
        BROKEN_LINE.name: profile_starts,
    }
    if curve.name not in known:
        raise ValueError(f"start values of {curve.name} must be given")
    return known[curve.name](cells, keys)


def self_start_fit(cells: DataFrame, curve: Curve, keys: Sequence[str] = ("family", "treatment")) -> DataFrame:
    """``fit_curve`` without start values."""
    cells = materialize(cells)
    return fit_curve(cells, curve, curve_starts(cells, curve, keys), keys, written=True)


def asymptotic_self_start(cells: DataFrame, keys: Sequence[str] = ("family", "treatment")) -> DataFrame:
    return self_start_fit(cells, ASYMPTOTIC, keys)


def logistic_self_start(cells: DataFrame, keys: Sequence[str] = ("family", "treatment")) -> DataFrame:
    return self_start_fit(cells, LOGISTIC, keys)


def _weighted_lines(cells: DataFrame, keys: list[str]) -> DataFrame:
    n, x = F.col("n"), F.col("x").cast("double")
    centre = cells.groupBy(*keys).agg(
        (F.sum(n * x) / F.sum("n")).alias("_mx"),
        (F.sum(n * F.col("mean")) / F.sum("n")).alias("_my"),
    )
    dx = x - F.col("_mx")
    return (
        cells.join(centre, keys)
        .groupBy(*keys)
        .agg(
            F.first("_mx").alias("_mx"),
            F.first("_my").alias("_my"),
            F.try_divide(
                F.sum(n * dx * (F.col("mean") - F.col("_my"))), F.sum(n * dx * dx)
            ).alias("slope"),
        )
        .withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
    )


def broken_line_starts(
    cells: DataFrame, breaks: Mapping[str, float], keys: Sequence[str] = ("family", "treatment")
) -> DataFrame:
    """Start values of the broken line: a line on each side of a first guess of the break.

    A treatment without a guess has no row here; its fit has status ``no start``.
    """
    keys = list(keys)
    guess = F.create_map(*(F.lit(v) for pair in breaks.items() for v in pair))
    at = cells.withColumn("break", guess[F.col("treatment")].cast("double")).where(
        F.col("break").isNotNull()
    )
    sides = at.withColumn("_late", F.col("x") > F.col("break"))
    lines = _weighted_lines(sides, [*keys, "break", "_late"])
    early = F.col("_late") == F.lit(False)
    return (
        lines.groupBy(*keys, "break")
        .agg(
            F.max(F.when(early, F.col("intercept"))).alias("start"),
            F.max(F.when(early, F.col("slope"))).alias("slope"),
            F.max(F.when(F.col("_late"), F.col("slope"))).alias("_right"),
        )
        .withColumn("turn", F.col("_right") - F.col("slope"))
        .select(*keys, "start", "slope", "turn", "break")
    )


def profile_starts(cells: DataFrame, keys: Sequence[str] = ("family", "treatment")) -> DataFrame:
    """Start values of the broken line at the least residual of all breaks.

    The points of a key are run through once in order of x. Sums up to each point and behind
    it give the two separate lines of every split, the place where they cross, brought back
    between the split's two points, and the residual of the continuous line that breaks there.
    A least-squares break is among these places, so no first guess is needed and none can
    mislead. A key with fewer than two points on either side of every split has no row here.
    """
    keys = list(keys)
    points = cells.groupBy(*keys, F.col("x").cast("double").alias("x")).agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("y"), F.sum("n").cast("double").alias("n")
    )
    centre = points.groupBy(*keys).agg(
        (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("_cx"), (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("_cy")
    )
    rows = points.join(centre, keys).withColumn("x", F.col("x") - F.col("_cx")).withColumn("y", F.col("y") - F.col("_cy"))
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    sums = {"n": n, "x": n * x, "y": n * y, "xx": n * x * x, "xy": n * x * y, "yy": n * y * y}
    order = Window.partitionBy(*keys).orderBy("x")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*keys)
    rows = rows.select(
        *keys,
        "x",
        "_cx",
        "_cy",
        F.lead("x").over(order).alias("_next"),
        F.row_number().over(order).alias("_left"),
        F.count(F.lit(1)).over(every).alias("_all"),
        *(F.sum(v).over(upto).alias(f"_l{c}") for c, v in sums.items()),
        *(F.sum(v).over(every).alias(f"_t{c}") for c, v in sums.items()),
    ).where((F.col("_left") >= 2) & (F.col("_all") - F.col("_left") >= 2))
    found = rows.select(*keys, F.struct(*(c for c in rows.columns if c not in keys)).alias("_p")).withColumn("_s", _broken_at("_p"))
    best = found.where(F.col("_s.rss").isNotNull()).groupBy(*keys).agg(F.min("_s").alias("_s"))
    return best.select(*keys, *(F.col(f"_s.{c}").alias(c) for c in BROKEN_LINE.params))


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("rss", "break", "start", "slope", "turn")]))
def _broken_at(p: pd.DataFrame) -> pd.DataFrame:
    """The continuous line that breaks where the lines of a split cross, for a whole batch of splits."""
    total = {c: p[f"_t{c}"].to_numpy(float) for c in ("n", "x", "y", "xx", "xy", "yy")}
    left = {c: p[f"_l{c}"].to_numpy(float) for c in total}
    right = {c: total[c] - left[c] for c in total}
    with np.errstate(all="ignore"):

        def line(s: dict) -> tuple[np.ndarray, np.ndarray]:
            slope = (s["n"] * s["xy"] - s["x"] * s["y"]) / (s["n"] * s["xx"] - s["x"] * s["x"])
            return (s["y"] - slope * s["x"]) / s["n"], slope

        (a1, b1), (a2, b2) = line(left), line(right)
        cross, low, high = (a1 - a2) / (b2 - b1), p["x"].to_numpy(float), p["_next"].to_numpy(float)
        at = np.clip(np.where(np.isfinite(cross), cross, (low + high) / 2), low, high)
        # sums of z = (x - at)+ over the points behind the split, and of its products
        z = right["x"] - at * right["n"]
        zz = right["xx"] - 2 * at * right["x"] + at * at * right["n"] - z * z / total["n"]
        xz, yz = right["xx"] - at * right["x"], right["xy"] - at * right["y"]
        det = total["xx"] * zz - xz * xz
        det = np.where(det > 1e-12 * total["xx"] * zz, det, np.nan)
        slope = (total["xy"] * zz - yz * xz) / det
        turn = (yz * total["xx"] - total["xy"] * xz) / det
        rss = total["yy"] - slope * total["xy"] - turn * yz
        cx, cy = p["_cx"].to_numpy(float), p["_cy"].to_numpy(float)
        out = {"rss": rss, "break": at + cx, "start": cy - slope * cx - turn * z / total["n"], "slope": slope, "turn": turn}
    return pd.DataFrame({c: pd.Series(v).where(np.isfinite(rss), None) for c, v in out.items()})


def segmented_fit(cells: DataFrame, breaks: Mapping[str, float] | Sequence[str] | None = None) -> DataFrame:
    """Straight line with one break per treatment.

    The break is a parameter of the curve: its Gauss-Newton step is the classic
    update by the ratio of the gap term to the slope change (Muggeo 2003). The steps
    start at the break of least residual (``profile_starts``), wherever a first
    guess would be. ``breaks`` names the treatments that have a break, all if it is
    left out; the others keep a row with status ``no start``. Where the points do not
    suffice for a search, a guess given in ``breaks`` is the start.
    """
    cells = materialize(cells)
    starts = profile_starts(cells)
    if breaks is not None:
        starts = starts.where(F.col("treatment").isin(list(breaks)))
    if isinstance(breaks, Mapping):
        starts = materialize(starts)
        keys = ["family", "treatment"]
        short = cells.where(F.col("treatment").isin(list(breaks))).select(*keys).distinct().join(starts, keys, "left_anti")
        if short.limit(1).count():
            starts = starts.unionByName(broken_line_starts(cells.join(short, keys, "left_semi"), breaks))
    return fit_curve(cells, BROKEN_LINE, starts, rounds_per_checkpoint=1, written=True)


def curve_error(fits: DataFrame, pool: Sequence[str] = ("family",)) -> DataFrame:
    """n, rss, parameters, df and sigma of the model made of all fits of a pool.

    One failed fit leaves the pooled residual unknown.
    """
    whole = F.bool_and("converged")
    return (
        fits.groupBy(*pool)
        .agg(
            F.sum("n").alias("n"),
            F.when(whole, F.sum("rss")).alias("rss"),
            F.sum("parameters").alias("parameters"),
        )
        .withColumn("df", F.col("n") - F.col("parameters"))
        .withColumn(
            "sigma", F.sqrt(F.when(F.col("df") > 0, F.try_divide(F.col("rss"), F.col("df"))))
        )
    )


def _with_error(fits: DataFrame, pool: Sequence[str], level: float | None = None) -> DataFrame:
    error = curve_error(fits, pool).select(*pool, "df", "sigma")
    if level is not None:
        error = error.withColumn("_crit", t_quantile(F.lit(level), "df"))
    return fits.join(error, list(pool))


def curve_summary(
    fits: DataFrame,
    curve: Curve,
    keys: Sequence[str] = ("family", "treatment"),
    pool: Sequence[str] = ("family",),
) -> DataFrame:
    """Long parameter table: estimate, se, df, t, p."""
    size = len(curve.params)
    rows = F.array(
        *(
            F.struct(
                F.lit(name).alias("param"),
                F.col(name).alias("estimate"),
                (F.col("sigma") * F.sqrt(F.col("unit_cov").getItem(i * size + i))).alias("se"),
            )
            for i, name in enumerate(curve.params)
        )
    )
    long = (
        _with_error(fits, pool)
        .select(*keys, "df", "sigma", F.inline(rows))
        .withColumn("t", F.try_divide(F.col("estimate"), F.col("se")))
    )
    return long.withColumn("p", t_two_sided("t", "df"))


def curve_wald_f(summary: DataFrame) -> DataFrame:
    """Wald F of each parameter: the baseline level against zero, and all levels equal.

    Fits of different treatments share only sigma, so the test of equality is
    the variance-weighted spread of the estimates about their weighted mean.
    """
    keys = ["family", "param"]
    weight = F.try_divide(F.lit(1.0), F.col("se") * F.col("se"))
    mean = summary.groupBy(*keys).agg(
        F.try_divide(F.sum(weight * F.col("estimate")), F.sum(weight)).alias("_m")
    )
    spread = F.col("estimate") - F.col("_m")
    parts = (
        summary.join(mean, keys)
        .groupBy(*keys)
        .agg(
            F.first("df").alias("df2"),
            F.min_by("t", "treatment").alias("_t"),
            (F.count(F.lit(1)) - 1).alias("_k"),
            F.sum(weight * spread * spread).alias("_q"),
        )
    )
    rows = F.array(
        F.struct(
            F.lit("(intercept)").alias("term"),
            F.lit(1).cast("long").alias("df1"),
            (F.col("_t") * F.col("_t")).alias("f"),
        ),
        F.struct(
            F.lit("treatment").alias("term"),
            F.col("_k").alias("df1"),
            F.try_divide(F.col("_q"), F.col("_k")).alias("f"),
        ),
    )
    long = parts.select(*keys, "df2", F.inline(rows))
    return long.withColumn("p", f_upper("f", "df1", "df2"))


def curve_lr_test(null_model: DataFrame, full_model: DataFrame) -> DataFrame:
    """Two nested models per family (tables with n, rss, parameters): criteria and LR test."""
    from trialframe.operators.linear import information_criteria

    def side(model, tag):
        return information_criteria(model.select("family", "n", "rss", "parameters")).select(
            "family", *(F.col(c).alias(f"{c}_{tag}") for c in ("model_df", "aic", "bic", "loglik"))
        )

    out = (
        side(null_model, "null")
        .join(side(full_model, "full"), "family")
        .withColumn("lr", F.lit(2.0) * (F.col("loglik_full") - F.col("loglik_null")))
        .withColumn("lr_df", F.col("model_df_full") - F.col("model_df_null"))
    )
    return out.withColumn("p", chi2_upper("lr", "lr_df"))


def curve_param_contrasts(summary: DataFrame) -> DataFrame:
    """Every parameter compared between treatments."""
    from trialframe.operators.means import pairwise_contrasts

    return pairwise_contrasts(summary, by=("family", "param"), value="estimate")


def _at_parameters(curve: Curve) -> dict[str, Column]:
    return {name: F.col(name) for name in curve.params}


def predict_curve(
    grid: DataFrame, fits: DataFrame, curve: Curve, on: Sequence[str] = ("treatment",)
) -> DataFrame:
    """Curve value at every grid point of its group."""
    joined = grid.join(fits.drop("n", "rss", "unit_cov", "rounds", "parameters"), list(on))
    value = curve.value(F.col("x").cast("double"), _at_parameters(curve))
    keep = [c for c in dict.fromkeys(["family", *on, *grid.columns])]
    return joined.select(*keep, value.alias("fitted"))


def curve_conf_band(
    grid: DataFrame,
    fits: DataFrame,
    curve: Curve,
    on: Sequence[str] = ("treatment",),
    pool: Sequence[str] = ("family",),
    level: float = 0.95,
) -> DataFrame:
    """Fitted value with its delta-method standard error and limits."""
    size = len(curve.params)
    joined = grid.join(_with_error(fits, pool, level), list(on))
    value, gradient = curve.terms(F.col("x").cast("double"), _at_parameters(curve))
    keep = [c for c in dict.fromkeys(["family", *on, *grid.columns])]
    rows = joined.select(
        *keep,
        "sigma",
        "_crit",
        "unit_cov",
        value.alias("fitted"),
        *(g.alias(f"_g{i}") for i, g in enumerate(gradient)),
    )
    quadratic = reduce(
        lambda a, b: a + b,
        (
            F.col(f"_g{i}") * F.col(f"_g{j}") * F.col("unit_cov").getItem(i * size + j)
            for i in range(size)
            for j in range(size)
        ),
    )
    rows = rows.withColumn("se", F.col("sigma") * F.sqrt(F.greatest(quadratic, F.lit(0.0))))
    reach = F.col("_crit") * F.col("se")
    return rows.select(
        *keep, "fitted", "se", (F.col("fitted") - reach).alias("lower"), (F.col("fitted") + reach).alias("upper")
    )


def curve_residuals(
    rows: DataFrame,
    fits: DataFrame,
    curve: Curve,
    on: Sequence[str] = ("family", "treatment"),
    pool: Sequence[str] = ("family",),
) -> DataFrame:
    """Fitted value, residual and residual / sigma of every observation (column ``y``).

    The rows are raw, so the parameters go to them where their size allows.
    """
    model = _with_error(fits, pool).select(*dict.fromkeys([*on, *pool]), *curve.params, "sigma")
    joined = rows.join(broadcast_if_small(materialize(model), 400), list(on))
    value = curve.value(F.col("x").cast("double"), _at_parameters(curve))
    return (
        joined.withColumn("fitted", value)
        .withColumn("residual", F.col("y") - F.col("fitted"))
        .withColumn("standardised", F.try_divide(F.col("residual"), F.col("sigma")))
        .drop(*curve.params, "sigma")
    )


def segment_table(fits: DataFrame, level: float = 0.95) -> DataFrame:
    """Slopes before and after the break and limits of the break, with errors."""
    at = {name: i for i, name in enumerate(BROKEN_LINE.params)}
    cov = lambda a, b: F.col("unit_cov").getItem(at[a] * 4 + at[b])
    sd = lambda v: F.col("sigma") * F.sqrt(F.greatest(v, F.lit(0.0)))
    right = cov("slope", "slope") + cov("turn", "turn") + F.lit(2.0) * cov("slope", "turn")
    rows = F.array(
        *(
            F.struct(F.lit(name).alias("term"), estimate.alias("estimate"), se.alias("se"))
            for name, estimate, se in (
                ("slope_before", F.col("slope"), sd(cov("slope", "slope"))),
                ("slope_after", F.col("slope") + F.col("turn"), sd(right)),
                ("break", F.col("break"), sd(cov("break", "break"))),
            )
        )
    )
    long = _with_error(fits, ("family",), level).select(
        "family", "treatment", "df", "_crit", F.inline(rows)
    )
    return (
        long.withColumn("lower", F.col("estimate") - F.col("_crit") * F.col("se"))
        .withColumn("upper", F.col("estimate") + F.col("_crit") * F.col("se"))
        .drop("_crit")
    )
