"""One curve for all against one curve per treatment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from trialframe.operators import curves as C
from trialframe.session import materialize


@dataclass(frozen=True)
class CurveComparison:
    """Result tables of a comparison; every field is a DataFrame."""

    null_fits: DataFrame
    full_fits: DataFrame
    test: DataFrame
    parameters: DataFrame
    wald: DataFrame
    contrasts: DataFrame


def compare_curves(
    cells: DataFrame, curve: C.Curve, starts: DataFrame | Mapping[str, float]
) -> CurveComparison:
    """Fit the null and the full model of every family and test them.

    The cell table is checkpointed once; both fits iterate on it.
    """
    cells = materialize(cells)
    null_fits = C.fit_curve(cells, curve, starts, keys=["family"], written=True)
    full_fits = C.fit_curve(cells, curve, starts, written=True)
    parameters = C.curve_summary(full_fits, curve)
    return CurveComparison(
        null_fits,
        full_fits,
        C.curve_lr_test(C.curve_error(null_fits), C.curve_error(full_fits)),
        parameters,
        C.curve_wald_f(parameters),
        C.curve_param_contrasts(parameters),
    )
