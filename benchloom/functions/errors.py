"""Prediction-error measures.  Aggregates take label and prediction columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: relative errors (or mean squares) above this count as infinite.
INFINITE_ABOVE = 100000.0


def _infinite() -> Column:
    return F.lit(float("inf"))


def signed_relative_error(y: Column, pred: Column) -> Column:
    """(y - pred) / y; for y = 0 infinite, or NaN when the prediction is 0 too."""
    zero = F.when(pred == 0, F.lit(float("nan"))).otherwise(_infinite())
    return F.when(y == 0, zero).otherwise(F.try_divide(y - pred, y))


def relative_error(y: Column, pred: Column) -> Column:
    """Absolute relative error of one row, infinite above the fixed bound."""
    error = F.abs(signed_relative_error(y, pred))
    return F.when(error > INFINITE_ABOVE, _infinite()).otherwise(error)


def rmsre(y: Column, pred: Column, copies: Column | None = None) -> Column:
    """Root mean squared relative error (aggregate); ``copies`` counts equal rows."""
    error = signed_relative_error(y, pred)
    square = error * error
    if copies is None:
        return F.sqrt(F.avg(square))
    return F.sqrt(F.try_divide(F.sum(square * copies), F.sum(F.when(square.isNotNull(), copies))))


def rmsre_capped(y: Column, pred: Column) -> Column:
    """Like :func:`rmsre`, infinite when the mean square is above the fixed bound."""
    error = signed_relative_error(y, pred)
    mean_square = F.avg(error * error)
    return F.when(mean_square > INFINITE_ABOVE, _infinite()).otherwise(F.sqrt(mean_square))


def rmsre_scaled(y: Column, pred: Column, scaler, name: str) -> Column:
    """:func:`rmsre_capped` of scaled values, after ``scaler`` (with ``backward``) inverts both."""
    return rmsre_capped(scaler.backward(y, name), scaler.backward(pred, name))


def rrmse(y: Column, pred: Column) -> Column:
    """Root mean squared error over the mean label (aggregate)."""
    return F.try_divide(F.sqrt(F.avg((y - pred) * (y - pred))), F.avg(y))


def rrse(y: Column, pred: Column) -> Column:
    """Root of squared error over squared deviation from the mean label (aggregate).

    With constant labels: 0 when every prediction is right, else 1.
    """
    squared = F.avg((y - pred) * (y - pred))
    spread = F.var_pop(y)
    flat = F.when(squared == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return F.when(spread == 0, flat).otherwise(F.sqrt(F.try_divide(squared, spread)))
