"""Detections against tracks: overlap joins, greedy one-to-one assignment, non-maximum suppression, grid bucketing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.geometry import Box

IOU_THRESHOLD, PENALTY_WEIGHT, NMS_THRESHOLD, CONFIDENCE = 0.3, 0.5, 0.45, 0.25


def overlap_join(tracks: DataFrame, detections: DataFrame, threshold: float = IOU_THRESHOLD, cells: int | None = None) -> DataFrame:
    """Pairs of a frame with at least ``threshold`` IoU: an equi-join on the frame with the overlap as condition.

    Crowded frames may set ``cells``: boxes are joined by the grid cells they touch, and a pair counts in the cell of
    its intersection's corner only, so it appears once.
    """
    sides = []
    for df, p in ((tracks, "a"), (detections, "b")):
        box = [F.col(c).alias(f"{p}{n}") for c, n in zip(("x_min", "y_min", "x_max", "y_max"), ("x0", "y0", "x1", "y1"), strict=True)]
        own = df.select("feed_id", "seq", F.col("det_id").alias("track_id" if p == "a" else "det_id"), *box)
        if cells:
            span = lambda lo, hi: F.sequence(F.floor(F.col(lo) * cells), F.floor(F.col(hi) * cells))
            own = own.withColumn("cx", F.explode(span(f"{p}x0", f"{p}x1"))).withColumn("cy", F.explode(span(f"{p}y0", f"{p}y1")))
        sides.append(own)
    a, b = Box.of("ax0", "ay0", "ax1", "ay1"), Box.of("bx0", "by0", "bx1", "by1")
    pairs = sides[0].join(sides[1], ["feed_id", "seq", *(["cx", "cy"] if cells else [])])
    if cells:
        corner = (F.floor(F.greatest("ax0", "bx0") * cells) == F.col("cx")) & (F.floor(F.greatest("ay0", "by0") * cells) == F.col("cy"))
        pairs = pairs.filter(corner).drop("cx", "cy")
    return pairs.withColumn("iou", a.iou(b, clamp_areas=True)).filter(F.col("iou") >= threshold)


def greedy(pairs: DataFrame, score: Column) -> DataFrame:
    """One-to-one matches of (feed_id, seq, track_id, det_id): by falling score, ties by track and detection.

    A fold over one frame's ordered candidates; a frame's candidates are few.
    """
    candidate = F.struct((-score).alias("cost"), "track_id", "det_id")
    frames = pairs.groupBy("feed_id", "seq").agg(F.array_sort(F.collect_list(candidate)).alias("candidates"))
    kind = "array<struct<cost:double,track_id:bigint,det_id:bigint>>"

    def fold(taken: Column, c: Column) -> Column:
        clash = F.exists(taken, lambda m: (m["track_id"] == c["track_id"]) | (m["det_id"] == c["det_id"]))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(c)))

    matched = F.aggregate("candidates", F.array().cast(kind), fold)
    out = frames.select("feed_id", "seq", F.explode(matched).alias("m"))
    return out.select("feed_id", "seq", F.col("m.track_id"), F.col("m.det_id"), (-F.col("m.cost")).alias("score"))


def suppressed(boxes: np.ndarray, classes: np.ndarray, threshold: float, union_guard: bool = True) -> np.ndarray:
    """Indices that stay of boxes in order of suppression: each suppresses later ones of its class.

    The overlap is compared with ``threshold`` times the union, without a division, as SQL does: a quotient rounds to the
    other side of the threshold for some pairs that lie on it. Not-a-number counts as in SQL: greatest, and equal to itself.
    ``union_guard``: boxes whose union is not positive do not overlap.
    """
    keep, gone = [], np.zeros(len(boxes), dtype=bool)
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    for i in range(len(boxes)):
        if gone[i]:
            continue
        keep.append(i)
        rest = slice(i + 1, None)
        w = np.fmin(boxes[i, 2], boxes[rest, 2]) - np.maximum(boxes[i, 0], boxes[rest, 0])
        h = np.fmin(boxes[i, 3], boxes[rest, 3]) - np.maximum(boxes[i, 1], boxes[rest, 1])
        both = np.maximum(w, 0) * np.maximum(h, 0)
        union = area[i] + area[rest] - both
        over = (both >= threshold * union) | np.isnan(both)
        if union_guard:
            over &= union > 0
        gone[rest] |= (classes[rest] == classes[i]) & over
    return np.array(keep, dtype=int)


def nms(detections: DataFrame, threshold: float = NMS_THRESHOLD, union_guard: bool = True) -> DataFrame:
    """Rows (feed_id, seq, det_id) that survive class-aware suppression, by falling score (ties by id, null last).

    Frames stream through sorted partitions. A box with a null neither suppresses nor is suppressed.
    """
    box = ["x_min", "y_min", "x_max", "y_max"]
    known = F.when(sum(map(F.col, box)).isNotNull(), F.col("class_id"))
    rows = detections.select("feed_id", "seq", "det_id", known.alias("class_id"), "conf", *box).repartition("feed_id", "seq")
    rows = rows.sortWithinPartitions("feed_id", "seq", F.desc_nulls_last("conf"), "det_id").drop("conf")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_frames(batches):
            frame = pdf[["feed_id", "seq"]].to_numpy()
            cuts = np.flatnonzero(np.any(frame[1:] != frame[:-1], axis=1)) + 1
            boxes, kind = pdf[box].to_numpy(), pdf["class_id"].to_numpy()
            keep = np.ones(len(pdf), dtype=bool)
            for i, j in zip(np.append(0, cuts).tolist(), np.append(cuts, len(pdf)).tolist(), strict=True):
                if j - i > 1:
                    keep[i:j] = False
                    keep[i + suppressed(boxes[i:j], kind[i:j], threshold, union_guard)] = True
            yield pdf.loc[keep, ["feed_id", "seq", "det_id"]]

    return rows.mapInPandas(run, "feed_id long, seq long, det_id long")


def whole_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows, cut so that no frame is split."""
    held = None
    for pdf in batches:
        pdf = (pdf if held is None else pd.concat([held, pdf])).reset_index(drop=True)
        if not len(pdf):
            continue
        last = (pdf["feed_id"] == pdf["feed_id"].iloc[-1]) & (pdf["seq"] == pdf["seq"].iloc[-1])
        held, done = pdf[last], pdf[~last]
        if len(done):
            yield done
    if held is not None and len(held):
        yield held


def decode_tensor(rows: DataFrame, tensor: str, threshold: float = CONFIDENCE, offset: int = 0) -> DataFrame:
    """Detections of a flat tensor of six values each; one whose length is no multiple of six holds none.

    A confidence that is not a number is kept, as it is not below the threshold.
    """
    n = F.size(tensor)
    parts = F.when(n % 6 == 0, F.transform(F.sequence(F.lit(0), F.floor(n / 6) - 1), lambda k: F.slice(tensor, (k * 6 + 1).cast("int"), 6)))
    kept = F.filter(F.when(n > 0, parts), lambda p: ~((p[4] < threshold) & ~F.isnan(p[4])))
    names = ("x1", "y1", "x2", "y2", "conf", "class_id")
    out = rows.select(*[c for c in rows.columns if c != tensor], F.posexplode(kept).alias("at", "p"))
    return out.select(*[c for c in rows.columns if c != tensor], (F.col("at") + offset).cast("long").alias("det_id"), *[F.col("p")[k].alias(c) for k, c in enumerate(names)])


def batch_problem(rank: Column, first: Column, last: Column, length: Column, frames: int) -> Column:
    """What is wrong with a model's batch output of shape (frames, rows, 6), or null."""
    return (
        F.when(rank != 3, "rank is not 3")
        .when(first != frames, "first dimension is not the batch size")
        .when(last != 6, "last dimension is not 6")
        .when(length < first * last, "too few values")
    )
