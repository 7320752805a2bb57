"""Scene bounds, Morton codes, and the steps of a radix sort as queryable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselar.functions.morton import compact, digit, interleave, interleave20, quantise
from tesselar.plans.scratch import exclusive_sum, with_position
from tesselar.schema import AXES

#: Elements of a work group, whose histogram is counted on its own.
GROUP = 256


def box_centers(boxes: DataFrame) -> DataFrame:
    return boxes.select("idx", *[((F.col(f"min_{a}") + F.col(f"max_{a}")) * 0.5).alias(f"c{a}") for a in AXES])


def scene_bounds(boxes: DataFrame) -> DataFrame:
    return boxes.agg(F.count(F.lit(1)).alias("n"), *[F.min(f"min_{a}").alias(f"min_{a}") for a in AXES], *[F.max(f"max_{a}").alias(f"max_{a}") for a in AXES])


def morton_code(boxes: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """(idx, code) of box centres within the scene; a flat axis counts as 1e-8 wide."""
    b = (scene_bounds(boxes) if bounds is None else bounds).select(*[F.col(f"{m}_{a}").alias(f"g{m}_{a}") for m in ("min", "max") for a in AXES])
    rows = boxes.crossJoin(F.broadcast(b))  # one row
    unit = [((F.col(f"min_{a}") + F.col(f"max_{a}")) * 0.5 - F.col(f"gmin_{a}")) / F.greatest(F.col(f"gmax_{a}") - F.col(f"gmin_{a}"), F.lit(1e-8)) for a in AXES]
    return rows.select(*boxes.columns, interleave(*[quantise(u) for u in unit]).alias("code"))


def fine_codes(boxes: DataFrame) -> DataFrame:
    """The boxes with ``coarse`` and ``fine``: a Morton code of 40 bits an axis, the upper 20 bits of each before the lower ones."""
    b = scene_bounds(boxes).select(*[F.col(f"{m}_{a}").alias(f"g{m}_{a}") for m in ("min", "max") for a in AXES])
    rows = boxes.crossJoin(F.broadcast(b))  # one row
    cells = []
    for a in AXES:
        centre = F.col(f"min_{a}") * 0.5 + F.col(f"max_{a}") * 0.5
        unit = (centre * 0.5 - F.col(f"gmin_{a}") * 0.5) / F.greatest(F.col(f"gmax_{a}") * 0.5 - F.col(f"gmin_{a}") * 0.5, F.lit(1e-300))  # halves, so that nothing overflows
        cells.append(F.floor(F.least(F.greatest(unit, F.lit(0.0)), F.lit(1.0)) * F.lit(float((1 << 40) - 1))).cast("long"))
    low = F.lit((1 << 20) - 1).cast("long")
    return rows.select(*boxes.columns, interleave20(*[F.shiftright(c, 20) for c in cells]).alias("coarse"), interleave20(*[c.bitwiseAND(low) for c in cells]).alias("fine"))


def morton_decode(codes: DataFrame) -> DataFrame:
    """Cells (mx, my, mz) and normalised coordinates of codes."""
    cells = [compact(F.shiftright("code", s)).alias(n) for n, s in (("mx", 2), ("my", 1), ("mz", 0))]
    return codes.select("idx", "code", *cells).select("*", *[(F.col(f"m{a}") / 1024.0).alias(f"u{a}") for a in AXES])


def morton_sort(codes: DataFrame) -> DataFrame:
    """Adds the position in the order of (code, idx)."""
    return with_position(codes, "code", "idx")


def radix_histogram(codes: DataFrame, at: int = 0) -> DataFrame:
    """(digit, wg, cnt) of the digits in each work group of a table with positions."""
    return codes.groupBy(digit(F.col("code"), at).alias("digit"), F.floor(F.col("pos") / GROUP).cast("long").alias("wg")).agg(F.count(F.lit(1)).alias("cnt"))


def radix_offsets(histogram: DataFrame) -> DataFrame:
    """Adds where each (digit, work group) begins."""
    return exclusive_sum(histogram, ["digit", "wg"], "cnt", "start")


def radix_scatter(codes: DataFrame, at: int = 0) -> DataFrame:
    """(idx, code, pos, new_pos): one stable pass of the sort. A rank is taken within a work group, which is small."""
    starts = radix_offsets(radix_histogram(codes, at)).select("digit", "wg", "start")
    rows = codes.withColumn("digit", digit(F.col("code"), at)).withColumn("wg", F.floor(F.col("pos") / GROUP).cast("long"))
    rank = F.row_number().over(Window.partitionBy("wg", "digit").orderBy("pos")) - 1
    return rows.withColumn("rank", rank).join(starts, ["digit", "wg"]).select("idx", "code", "pos", (F.col("start") + F.col("rank")).cast("long").alias("new_pos"))


def radix_sort(codes: DataFrame, passes: int = 8) -> DataFrame:
    """All passes one after another; ``with_position`` gives the same order in one."""
    for p in range(passes):
        codes = radix_scatter(codes, p).select("idx", "code", F.col("new_pos").alias("pos"))
    return codes
