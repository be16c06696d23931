"""End-effector states -> pixel traces with their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G
from ..functions import vocab as V
from ..operators.aggregates import bounds_aggregates, reprojection_aggregates
from ..operators.frames import delta_stats
from ..operators.ordered import Ordered


MATRIX, INVERSE = G.Entries("_m"), G.Entries("_i")
FLIP = ["_sx", "_ox", "_sy", "_oy"]


def prepare_cameras(cameras: DataFrame, camera: str, width: int, height: int) -> DataFrame:
    """Per camera, once: the matrix, its inverse and the image convention as plain numbers.

    The frames then multiply scalar columns inside generated code; no array is read per frame.
    """
    c = cameras.withColumn("_inverse", G.inverse_matrix(F.col("matrix")))
    cells = [(i, j) for i in range(4) for j in range(4)]
    return c.select(
        camera,
        *[F.col("matrix")[i][j].alias(f"_m{i}{j}") for i, j in cells],
        *[F.col("_inverse")[i][j].alias(f"_i{i}{j}") for i, j in cells],
        *[t.alias(n) for t, n in zip(G.flip_terms(F.col("convention"), width, height), FLIP)],
    )


def distinct_calibrations(episodes: DataFrame, calibrate: DataFrame, keys: list[str]) -> DataFrame:
    """Calibration rows for the distinct (file, camera, width, height) that occur, each once."""
    return episodes.select(*keys).distinct().join(calibrate, keys, "left")


def project_points(frames: DataFrame, cameras: DataFrame, camera: str = "camera", width=256, height=256) -> DataFrame:
    """Frames with world x, y, z -> pixel, depth, bounds and reprojection errors. Column arithmetic only.

    A frame whose camera is not in the table keeps its row: no pixel, out of bounds. ``uncalibrated`` lists them.
    """
    j = frames.join(prepare_cameras(cameras, camera, width, height), camera, "left")
    terms = [F.col(n) for n in FLIP]
    u, v, depth = G.project(F.col("wx"), F.col("wy"), F.col("wz"), MATRIX, terms)
    j = j.withColumns({"raw_x": u, "raw_y": v, "depth": depth})
    inside = F.coalesce(G.visible(F.col("raw_x"), F.col("raw_y"), F.col("depth"), width, height), F.lit(False))
    j = j.withColumns(
        {
            "in_bounds": inside,
            "x": F.when(F.col("raw_x").isNotNull(), G.half_even(G.clamp(F.col("raw_x"), 0.0, F.lit(float(width - 1))))),
            "y": F.when(F.col("raw_y").isNotNull(), G.half_even(G.clamp(F.col("raw_y"), 0.0, F.lit(float(height - 1))))),
        }
    )

    def error(px, py):
        back = G.reproject(px, py, F.col("depth"), INVERSE, terms)
        return G.distance(*[b - F.col(w) for b, w in zip(back, ("wx", "wy", "wz"))])

    j = j.withColumn("exact_error", error(F.col("raw_x"), F.col("raw_y")))
    j = j.withColumn("rounded_error", F.when(F.col("in_bounds"), error(F.col("x").cast("double"), F.col("y").cast("double"))))
    return j.drop(*[c for c in j.columns if c in FLIP or c[:2] in ("_m", "_i") and c[2:].isdigit()])


def uncalibrated(frames: DataFrame, cameras: DataFrame, camera: str = "camera") -> DataFrame:
    """(camera, frames) for cameras that frames name and the table lacks; a null camera is one of them."""
    return frames.join(cameras.select(camera), camera, "left_anti").groupBy(camera).agg(F.count(F.lit(1)).alias("frames"))


def trace_stats(o: Ordered) -> DataFrame:
    """Per trace: points, bounds, reprojection errors and step distances, in one pass over its rows."""
    return delta_stats(o, also=[*bounds_aggregates(), *reprojection_aggregates()])


def gate(
    stats: DataFrame,
    keys: list[str],
    max_delta: float = V.MAX_STEP_DELTA_PIXELS,
    max_out_of_bounds: float = V.MAX_OUT_OF_BOUNDS_FRACTION,
    max_exact: float = V.MAX_EXACT_REPROJECTION_METERS,
    max_rounded: float = V.MAX_ROUNDED_REPROJECTION_METERS,
) -> DataFrame:
    """(keys, rule) for traces beyond a limit."""
    if min(max_delta, max_exact, max_rounded) <= 0:
        raise ValueError("limits must be positive")
    rules = F.array_compact(
        F.array(
            F.when(F.col("max_delta") > max_delta, "step_jump"),
            F.when(F.col("out_of_bounds_fraction") > max_out_of_bounds, "out_of_bounds"),
            F.when(F.col("exact_max_error") > max_exact, "exact_error"),
            F.when(F.col("rounded_max_error") > max_rounded, "rounded_error"),
        )
    )
    return stats.select(*keys, F.explode(rules).alias("rule"))


def replay_check(recorded: DataFrame, replayed: DataFrame, keys: list[str], steps: int = 30) -> DataFrame:
    """Distance of recorded and replayed positions over the first ``steps`` steps."""
    a = recorded.filter(F.col("step") < steps)
    b = replayed.filter(F.col("step") < steps).select(*keys, "step", *[F.col(c).alias(f"_{c}") for c in ("wx", "wy", "wz")])
    gap = G.distance(*[F.col(c) - F.col(f"_{c}") for c in ("wx", "wy", "wz")])
    return a.join(b, [*keys, "step"]).select(*keys, "step", gap.alias("distance"))
