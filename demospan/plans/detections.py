"""Detections of one image: drop and merge near-copies, then fuse the scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G
from ..functions import vocab as V
from ..operators.components import components
from ..operators.joins import by_shuffle
from ..session import cut_lineage

BOX = ["x", "y", "w", "h"]
#: grid of a fine cell, in the logarithm of a side and in sides, and the least overlap of two boxes of one
FINE, SAME_CELL = 0.01, 0.92
#: boxes of a frame that are compared without a grid
FEW = 64


def high_enough(detections: DataFrame, least: float = V.MIN_BOX_TOP, only_with_tracks: bool = False) -> DataFrame:
    """Drop boxes whose top edge is above ``least``.

    ``only_with_tracks`` keeps the first detection of a frame whatever its height, as the online
    loop does: it looks at the height only when it compares with an earlier track.
    """
    low = F.col("y") >= least
    if not only_with_tracks:
        return detections.filter(low)
    first = detections.groupBy("frame").agg(F.min("rank").alias("_first"))
    return detections.join(first, "frame").filter(low | (F.col("rank") == F.col("_first"))).drop("_first")


def overlapping_pairs(detections: DataFrame, ratio: float = V.OVERLAP_RATIO) -> DataFrame:
    """Pairs of one frame that overlap by more than ``ratio``: (frame, a, b, overlap, a_copies, b_copies).

    Exact copies of a box are folded into its smallest id with a count, so a box repeated a million
    times gives one row per neighbour and not a million squared.

    Two boxes that overlap so much have nearly the same size and corner. In a frame of more than ``FEW``
    boxes sizes are put on a logarithmic grid and corners on a grid as fine as the size allows; only boxes in
    neighbouring cells meet, so a large frame's boxes are never all compared with each other. A smaller frame
    is one cell: its boxes need not be repeated for their neighbours.
    """
    step = math.log(1 / ratio)
    d = (
        detections.filter((F.col("w") > 0) & (F.col("h") > 0))
        .groupBy("frame", *BOX)
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    )

    def pairs(a: DataFrame, b: DataFrame, *cell: str) -> DataFrame:
        a = a.select("frame", *cell, F.col("id").alias("a"), F.col("copies").alias("a_copies"), *[F.col(c).alias(f"a_{c}") for c in BOX])
        b = b.select("frame", *cell, F.col("id").alias("b"), F.col("copies").alias("b_copies"), *[F.col(c).alias(f"b_{c}") for c in BOX])
        j = by_shuffle(a, b, ["frame", *cell]).filter(F.col("a") < F.col("b"))
        overlap = G.overlap_ratio({c: F.col(f"a_{c}") for c in BOX}, {c: F.col(f"b_{c}") for c in BOX})
        return j.withColumn("overlap", overlap).filter(F.col("overlap") > ratio).select("frame", "a", "b", "overlap", "a_copies", "b_copies")

    def cells(df: DataFrame, spread: bool) -> DataFrame:
        sizes = {"_kw": F.floor(F.log("w") / step), "_kh": F.floor(F.log("h") / step)}
        df = df.withColumns({k: c.cast("bigint") for k, c in sizes.items()})
        if spread:
            for k in ("_kw", "_kh"):
                df = df.withColumn(k, F.explode(F.array(*[F.col(k) + i for i in (-1, 0, 1)])))
        # with ratio r the corners differ by at most (1 - r) of the larger side, which is at most 1/r of
        # the class's largest side; the cell is wider than that, so such boxes lie in neighbouring cells
        edge = (1 - ratio) * ratio**-2
        for k, size, at in (("_cx", "_kw", "x"), ("_cy", "_kh", "y")):
            side = F.exp((F.col(size) + 1) * step) * edge
            df = df.withColumn(k, F.floor(F.col(at) / side).cast("bigint"))
            if spread:
                df = df.withColumn(k, F.explode(F.array(*[F.col(k) + i for i in (-1, 0, 1)])))
        return df

    crowded = _crowded(detections)
    if crowded.isEmpty():
        return pairs(d, d)
    few, many = _parted(d, crowded)
    return pairs(few, few).unionByName(pairs(cells(many, False), cells(many, True), "_kw", "_kh", "_cx", "_cy"))


def _crowded(detections: DataFrame) -> DataFrame:
    """The frames with more than ``FEW`` boxes or one without a place or size, and rows without a frame; written down."""
    lacks = F.greatest(*[F.col(c).isNull() for c in BOX])
    n = detections.groupBy("frame").agg(F.count(F.lit(1)).alias("_n"), F.bool_or(lacks).alias("_lacks"))
    return cut_lineage(n.filter((F.col("_n") > FEW) | F.col("_lacks") | F.col("frame").isNull()).select(F.col("frame").alias("_crowded")))


def _parted(boxes: DataFrame, crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boxes of small whole frames, all others)."""
    same = F.col("frame").eqNullSafe(F.col("_crowded"))
    return boxes.join(crowded, same, "left_anti"), boxes.join(crowded, same, "left_semi")


def merge_groups(detections: DataFrame, ratio: float = V.OVERLAP_RATIO) -> DataFrame:
    """``detections`` with ``part``: boxes of a frame that overlap by more than ``ratio`` are in one part.

    Boxes of a fine cell overlap by more than ``SAME_CELL``, so a cell stands for all of them, however many
    jittered copies it holds. One minus the overlap obeys the triangle inequality; so where two boxes overlap by
    more than ``ratio``, the boxes that stand for their cells overlap by what is left of it. Parts are the
    components of these cells. A part may hold more than must be together, which changes no result: a frame of
    at most ``FEW`` boxes is one part.
    """
    crowded, whole = _crowded(detections), F.lit(0).cast("bigint")
    if crowded.isEmpty():
        return detections.withColumn("part", whole)
    few, many = _parted(detections, crowded)
    return few.withColumn("part", whole).unionByName(_cell_groups(many, ratio))


def _cell_groups(detections: DataFrame, ratio: float) -> DataFrame:
    """``detections`` with ``part``, by the cells of their boxes."""
    sizes = {"_kw": F.floor(F.log("w") / FINE), "_kh": F.floor(F.log("h") / FINE)}
    cell = [F.col("_kw"), F.col("_kh")]
    for k, at in (("_kw", "x"), ("_kh", "y")):
        cell.append(F.floor(F.col(at) / (F.exp(F.col(k) * FINE) * FINE)))
    flat = (F.col("w") > 0) & (F.col("h") > 0)
    d = detections.withColumns({k: F.when(flat, c).cast("double") for k, c in sizes.items()})
    d = d.withColumn("_cell", F.when(flat, F.xxhash64("frame", *cell)).otherwise(F.xxhash64("frame", *BOX))).drop("_kw", "_kh")
    stands = d.groupBy("frame", "_cell").agg(F.min(F.struct(*BOX)).alias("_b")).select("frame", F.col("_cell").alias("id"), "_b.*")
    links = overlapping_pairs(stands, ratio - 2 * (1 - SAME_CELL))
    roots = components(links.select("a", "b")).withColumnRenamed("node", "_cell")
    return d.join(roots, "_cell", "left").withColumn("part", F.coalesce("root", "_cell")).drop("_cell", "root")


def merge_detections(detections: DataFrame, ratio: float = V.OVERLAP_RATIO) -> DataFrame:
    """Greedy merge in rank order: of two near-copies the higher score stays and class scores add up.

    The result depends on the order, so boxes are walked in rank order, but only boxes that may meet: each
    part of a frame (``merge_groups``) is walked by itself, its rows streamed in sorted batches, and only its
    surviving tracks are kept. A frame of any size is spread over tasks by its parts.

    ``detections``: (frame, rank, id, x, y, w, h, scores array<double>).
    """
    cols = ["frame", "part", "rank", "id", *BOX, "scores"]
    types = dict(detections.dtypes)
    parts = merge_groups(detections.select("frame", "rank", "id", *BOX, "scores"), ratio)
    walked = parts.select(*cols).repartition("frame", "part").sortWithinPartitions("frame", "part", "rank")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tracks = None, []
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                if now is not None and (row.frame, row.part) != now:
                    out += _rows(now[0], tracks)
                    tracks = []
                now = row.frame, row.part
                _take(tracks, row, ratio)
            yield pd.DataFrame(out, columns=["frame", "id", *BOX, "scores"])
        if now is not None:
            yield pd.DataFrame(_rows(now[0], tracks), columns=["frame", "id", *BOX, "scores"])

    schema = f"frame {types['frame']}, id {types['id']}, x double, y double, w double, h double, scores array<double>"
    return walked.mapInPandas(run, schema)


def _rows(frame, tracks: list[dict]) -> list[tuple]:
    return [(frame, t["id"], *t["box"], list(t["scores"])) for t in tracks]


def _take(tracks: list[dict], row, ratio: float) -> None:
    """Add one detection to the tracks it may meet.

    It goes into the first overlapping track whose best score is no less than its own; the overlapping tracks
    before that one, or all where there is none, end in it.
    """
    box, own = (row.x, row.y, row.w, row.h), [float(s) for s in row.scores]
    near = [t for t in tracks if _overlap(box, t["box"]) > ratio]
    better = next((i for i, t in enumerate(near) if max(t["scores"]) >= max(own)), len(near))
    total = own
    for t in near[: better + 1]:
        total = [a + b for a, b in zip(total, t["scores"])]
    ended = {id(t) for t in near[:better]}
    if ended:
        tracks[:] = [t for t in tracks if id(t) not in ended]
    if better < len(near):
        near[better]["scores"] = total
    else:
        tracks.append({"id": row.id, "box": box, "scores": total})


def _overlap(a, b) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(w, 0.0) * max(h, 0.0)
    union = a[2] * a[3] + b[2] * b[3] - both
    return both / union if union else 0.0
