"""Ordered series at scale: positions, segments with a halo, and windows over them.

A window over a whole series would put one ticker into one task. Here a series is
cut into segments of ``SEGMENT`` rows; each segment also carries the rows just before
(``back``) and after it (``ahead``) that its own rows look at. A hot ticker thus spreads
over many tasks, and one shuffle serves every trailing and leading window of a job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SEGMENT = 2048


def with_position(frame: DataFrame, *, series: tuple[str, ...] = ("ticker",),
                  order: str = "timestamp", spread: int | None = None) -> DataFrame:
    """Add ``position`` (0-based rank in its series) and ``length`` (rows in the series).

    Rows are counted per calendar year first; only those counts are summed per series,
    so the ranking itself never sees more than one year of one series in a task. ``spread`` is the
    number of partitions the years are dealt to, if not the session's.
    """
    dated = frame.withColumn("_year", F.year(order))
    per_year = dated.groupBy(*series, "_year").agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*series)
    earlier = whole.orderBy("_year").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_year.select(
        *series, "_year",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("length"))
    inside = Window.partitionBy(*series, "_year").orderBy(order)
    dealt = dated if spread is None else dated.repartition(spread, *series, "_year")
    return (dealt.withColumn("_rank", F.row_number().over(inside))
            .join(offsets, [*series, "_year"])
            .withColumn("position", F.col("_before") + F.col("_rank") - 1)
            .drop("_year", "_rank", "_before"))


def cut(frame: DataFrame, *, back: int, ahead: int, size: int = SEGMENT) -> DataFrame:
    """Copy each row into its own segment and into those whose halo it belongs to.

    How far ``back`` the halo reaches stays with the frame, as metadata of ``segment``.
    """
    first = F.greatest(F.floor((F.col("position") - ahead) / size), F.lit(0))
    last = F.least(F.floor((F.col("position") + back) / size),
                   F.floor((F.col("length") - 1) / size))
    return (frame.withColumn("segment", F.explode(F.sequence(first, last)))
            .withColumn("own", F.floor(F.col("position") / size) == F.col("segment"))
            .withMetadata("segment", {"back": back}))


def need(frame: DataFrame, rows: int) -> None:
    """Refuse a frame whose segments carry fewer than ``rows`` rows before their own.

    A shorter halo would give windows that look full but miss their oldest rows. Frames of
    whole series (``whole``) satisfy any need; so does one cut elsewhere, without metadata.
    """
    back = frame.schema["segment"].metadata.get("back") if "segment" in frame.columns else None
    if back is not None and back < rows:
        raise ValueError(f"these windows reach {rows} rows back, the frame was cut with {back}")


def whole(frame: DataFrame, *, series: tuple[str, ...] = ("ticker",), order: str = "timestamp") -> DataFrame:
    """One segment per series, for series bounded by the calendar (an index, a fold)."""
    w = Window.partitionBy(*series)
    return frame.withColumns({
        "position": F.row_number().over(w.orderBy(order)) - F.lit(1).cast("long"),
        "length": F.count(F.lit(1)).over(w),
        "segment": F.lit(0).cast("long"), "own": F.lit(True)})


def own_rows(frame: DataFrame) -> DataFrame:
    """Drop the halo again: one copy of each row is left."""
    return frame.where("own").drop("segment", "own")


# The same window as SQL text; ``trailing`` adds a frame to it.
OVER = "over (partition by ticker, segment order by position)"


def over(series: tuple[str, ...] = ("ticker",)) -> WindowSpec:
    return Window.partitionBy(*series, "segment").orderBy("position")


def trailing(rows: int) -> str:
    """The current row and the ``rows - 1`` before it."""
    return f"{OVER[:-1]} rows between {rows - 1} preceding and current row)"


def preceding(rows: int) -> str:
    """The ``rows`` rows before the current one."""
    return f"{OVER[:-1]} rows between {rows} preceding and 1 preceding)"
