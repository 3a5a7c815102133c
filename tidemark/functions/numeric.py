"""Numeric column expressions; undefined is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16  # spacing of doubles at 1.0


def defined(value: Column) -> Column:
    """Turn NaN from outside into NULL."""
    return F.when(~F.isnan(value), value)


def touches(value: Column, level: Column, *, above: bool) -> Column:
    """Level reached, allowing eight units of rounding."""
    slack = F.lit(8 * EPSILON) * F.greatest(F.abs(value), F.abs(level))
    return value >= level - slack if above else value <= level + slack


def spacing(value: Column) -> Column:
    """Distance from a positive double to the next larger one."""
    return F.pow(F.lit(2.0), F.floor(F.log2(value)) - 52)


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def with_costs(entry: Column, exit_: Column, commission: float, slippage: float) -> dict[str, Column]:
    """Fill prices and returns after slippage and commission on both sides."""
    buy, sell = entry * (1 + slippage), exit_ * (1 - slippage)
    return {
        "entry_fill_price": buy,
        "exit_fill_price": sell,
        "gross_return": exit_ / entry - 1,
        "net_return": sell * (1 - commission) / (buy * (1 + commission)) - 1,
    }


def scaled_barriers(entry: Column, atr: Column, stop_multiple: float, target_multiple: float) -> dict[str, Column]:
    """Barrier prices and fractions at multiples of a range known at signal time."""
    stop, target = atr * stop_multiple, atr * target_multiple
    sound = (entry > 0) & (atr > 0) & (entry - stop > 0)
    return {
        "stop_price": F.when(sound, entry - stop),
        "target_price": F.when(sound, entry + target),
        "stop_fraction": F.when(sound, stop / entry),
        "target_fraction": F.when(sound, target / entry),
    }


def binned(value: Column, edges: tuple[float, float]) -> Column:
    """Right-closed three-way bin; undefined values are kept as ``unknown``."""
    return (F.when(value.isNull(), "unknown").when(value <= edges[0], "low")
            .when(value <= edges[1], "middle").otherwise("high"))


def rounded(frame: DataFrame) -> DataFrame:
    """Round every double for display: six decimals below ten, three below a million."""
    def short(name: str) -> Column:
        x = F.col(f"`{name}`")
        return (F.when(F.abs(x) < 10, F.floor(x * 1e6 + 0.5) / 1e6)
                .when(F.abs(x) < 1e6, F.floor(x * 1e3 + 0.5) / 1e3).otherwise(x).alias(name))
    return frame.select(*[
        short(field.name) if field.dataType.typeName() == "double" else F.col(f"`{field.name}`")
        for field in frame.schema.fields])
