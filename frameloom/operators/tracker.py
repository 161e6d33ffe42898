"""A multi-object tracker with a constant-velocity Kalman filter and observation-centred association.

All tracks of a feed are arrays, so a frame costs a few numpy calls and no loop over tracks. State per track: centre,
area, aspect and the first three's velocities. The covariance steps keep the simplified forms whose results are to be
matched: prediction adds the velocity rows, the correction uses the old diagonal only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

POSITION, VELOCITY = 1 / 20, 1 / 160


@dataclass(frozen=True)
class Config:
    iou_threshold: float = 0.3
    penalty_weight: float = 0.5
    max_age: int = 30
    min_hits: int = 3
    output_tentative: bool = False


def measured(boxes: np.ndarray) -> np.ndarray:
    w, h = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
    flat = np.abs(h) <= 1e-8
    return np.stack([boxes[:, 0] + w / 2, boxes[:, 1] + h / 2, w * h, np.where(flat, 1.0, w / np.where(flat, 1.0, h))], axis=1)


def boxes_of(x: np.ndarray) -> np.ndarray:
    area, ratio = np.maximum(x[:, 2], 1e-8), np.maximum(x[:, 3], 1e-4)
    w = np.sqrt(area * ratio)
    h = area / np.maximum(w, 1e-8)
    return np.stack([x[:, 0] - w / 2, x[:, 1] - h / 2, x[:, 0] + w / 2, x[:, 1] + h / 2], axis=1)


def predicted(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, q = x.copy(), p.copy()
    x[:, :3] += x[:, 4:]
    x[:, 2] = np.maximum(x[:, 2], 1e-6)
    across = np.array([4, 5, 6, 3, 4, 5, 6])  # the velocity's column for a position's, else the column itself
    q[:, :3] += p[:, 4:] + p[:, :3][:, :, across] + p[:, 4:][:, :, across]
    size = np.abs(x[:, 2])
    k = np.arange(7)
    q[:, k, k] += np.where(k < 4, POSITION**2, VELOCITY**2) * size[:, None]
    return x, q


def inverses(s: np.ndarray) -> np.ndarray:
    """Of each 4 x 4 matrix; a singular one gives the identity."""
    try:
        return np.linalg.inv(s)
    except np.linalg.LinAlgError:
        out = np.broadcast_to(np.eye(4), s.shape).copy()
        for k, m in enumerate(s):
            if np.linalg.matrix_rank(m) == 4:
                out[k] = np.linalg.inv(m)
        return out


def corrected(x: np.ndarray, p: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    noise = POSITION**2 * np.abs(x[:, 2])
    gain = p[:, :, :4] @ inverses(p[:, :4, :4] + noise[:, None, None] * np.eye(4))
    q = p.copy()
    q[:, :, :4] -= gain * p[:, np.arange(4), np.arange(4)][:, None, :]
    return x + (gain @ (z - x[:, :4])[:, :, None])[:, :, 0], q


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.prod(np.maximum(high - low, 0), axis=2)
    area = [np.maximum(m[:, 2] - m[:, 0], 0) * np.maximum(m[:, 3] - m[:, 1], 0) for m in (a, b)]
    union = area[0][:, None] + area[1][None] - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0)


def penalties(direction: np.ndarray, tracks: np.ndarray, detections: np.ndarray) -> np.ndarray:
    """``direction`` is NaN for a track that has not moved."""
    centre = lambda m: (m[:, :2] + m[:, 2:]) / 2
    way = centre(detections)[None] - centre(tracks)[:, None]
    norm = np.sqrt((way**2).sum(axis=2))
    cosine = np.clip((direction[:, None] * way).sum(axis=2) / np.where(norm < 1e-8, 1, norm), -1, 1)
    return np.where((norm < 1e-8) | np.isnan(cosine), 0, (1 - cosine) / 2)


def assign(score: np.ndarray, allowed: np.ndarray) -> list[tuple[int, int]]:
    """Greedy one-to-one pairs by falling score; ties by track, then detection."""
    rows, columns = np.nonzero(allowed)
    order = np.lexsort((columns, rows, -score[rows, columns]))
    used: tuple[set, set] = (set(), set())
    out = []
    for k in order:
        r, c = int(rows[k]), int(columns[k])
        if r not in used[0] and c not in used[1]:
            used[0].add(r)
            used[1].add(c)
            out.append((r, c))
    return out


@dataclass
class Tracker:
    """Tracks of one feed; ``update`` takes a frame's detections and returns what is to be shown."""

    config: Config = field(default_factory=Config)
    next_id: int = 1

    def __post_init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        """Forget the tracks, as at a new view epoch; ids go on."""
        self.x, self.p = np.zeros((0, 7)), np.zeros((0, 7, 7))
        self.last, self.second = np.zeros((0, 4)), np.full((0, 4), np.nan)
        self.direction = np.full((0, 2), np.nan)
        self.info = np.zeros((0, 5), dtype=np.int64)  # id, class, detection, frames since an update, hits in a row
        self.confidence = np.zeros(0)

    def _correct(self, rows: np.ndarray, z: np.ndarray) -> None:
        way = z[:, :2] - self.last[rows, :2]
        norm = np.sqrt((way**2).sum(axis=1))
        moved = norm > 1e-8
        self.direction[rows[moved]] = way[moved] / norm[moved, None]
        self.x[rows], self.p[rows] = corrected(self.x[rows], self.p[rows], z)
        self.second[rows], self.last[rows] = self.last[rows], z
        self.info[rows, 3] = 0

    def _rewind(self, rows: np.ndarray) -> None:
        """Run again from the second-last observation to the last, for tracks that were away."""
        rows = rows[~np.isnan(self.second[rows, 0])]
        if len(rows):
            self.x[rows] = np.concatenate([self.second[rows], np.zeros((len(rows), 3))], axis=1)
            self.x[rows], self.p[rows] = predicted(self.x[rows], self.p[rows])
            self._correct(rows, self.last[rows].copy())

    def update(self, boxes: np.ndarray, classes: np.ndarray, ids: np.ndarray, confidence: np.ndarray) -> list[tuple]:
        """(track_id, class_id, state, confidence, detection_id, x_min, y_min, x_max, y_max) of each shown track."""
        self.x, self.p = predicted(self.x, self.p)
        self.info[:, 3] += 1
        z = measured(boxes)
        shown = boxes_of(self.x)
        iou = overlaps(shown, boxes)
        score = iou - self.config.penalty_weight * penalties(self.direction, shown, boxes)
        pairs = np.array(assign(score, iou >= self.config.iou_threshold), dtype=int).reshape(-1, 2)
        rows, hits = pairs[:, 0], pairs[:, 1]
        if len(rows):
            self._rewind(rows[self.info[rows, 3] > 1])
            self._correct(rows, z[hits])
            self.info[rows, 4] += 1
            self.info[rows, 1], self.info[rows, 2], self.confidence[rows] = classes[hits], ids[hits], confidence[hits]
        idle = np.setdiff1d(np.arange(len(self.x)), rows)
        self.info[idle, 4] = 0
        self._spawn(np.setdiff1d(np.arange(len(boxes)), hits), z, classes, ids, confidence)
        self._keep(self.info[:, 3] <= self.config.max_age)
        return self._shown()

    def _spawn(self, new: np.ndarray, z: np.ndarray, classes: np.ndarray, ids: np.ndarray, confidence: np.ndarray) -> None:
        n = len(new)
        if not n:
            return
        numbers = np.arange(self.next_id, self.next_id + n)
        self.next_id += n
        self.x = np.concatenate([self.x, np.concatenate([z[new], np.zeros((n, 3))], axis=1)])
        self.p = np.concatenate([self.p, np.broadcast_to(np.diag([10.0] * 4 + [1000.0] * 3), (n, 7, 7))])
        self.last, self.second = np.concatenate([self.last, z[new]]), np.concatenate([self.second, np.full((n, 4), np.nan)])
        self.direction = np.concatenate([self.direction, np.full((n, 2), np.nan)])
        self.info = np.concatenate([self.info, np.stack([numbers, classes[new], ids[new], np.zeros(n, int), np.ones(n, int)], axis=1)])
        self.confidence = np.concatenate([self.confidence, confidence[new]])

    def _keep(self, which: np.ndarray) -> None:
        for name in ("x", "p", "last", "second", "direction", "info", "confidence"):
            setattr(self, name, getattr(self, name)[which])

    def _shown(self) -> list[tuple]:
        out = []
        for (number, class_id, det_id, away, streak), conf, box in zip(self.info.tolist(), self.confidence.tolist(), boxes_of(self.x).tolist(), strict=True):
            state = lifecycle(away, streak, self.config)
            if state != "Tentative" or self.config.output_tentative:
                out.append((number, class_id, state, conf, det_id, *box))
        return out


def lifecycle(away: int, streak: int, config: Config) -> str:
    if away > 0:
        return "Lost" if away > config.max_age // 2 else "Coasted"
    return "Confirmed" if streak >= config.min_hits else "Tentative"


class FeedTracker:
    """A fold over a feed's rows in order of frame: a frame is tracked when its last row has come. Rows that are not
    ``detected`` stand for a frame itself, which is tracked without detections too."""

    def __init__(self, config: Config | None = None):
        self.tracker = Tracker(config or Config())
        self.frame: list[dict] = []
        self.epoch = None

    def step(self, row: dict) -> list[tuple]:
        out = self.flush() if self.frame and self.frame[0]["seq"] != row["seq"] else []
        self.frame.append(row)
        return out

    def flush(self) -> list[tuple]:
        if not self.frame:
            return []
        rows, self.frame = self.frame, []
        epoch = next((r["epoch"] for r in rows if r.get("epoch") is not None), self.epoch)
        if epoch != self.epoch and self.epoch is not None:
            self.tracker.reset()
        self.epoch = epoch
        found = [r for r in rows if r.get("detected", True)]
        boxes = np.array([[r["x_min"], r["y_min"], r["x_max"], r["y_max"]] for r in found], dtype=float).reshape(-1, 4)
        columns = [np.array([r[c] for r in found], dtype=kind) for c, kind in (("class_id", np.int64), ("det_id", np.int64), ("conf", float))]
        return [(rows[0]["feed_id"], rows[0]["seq"], *t) for t in self.tracker.update(boxes, *columns)]


TRACKS = "feed_id long, seq long, track_id long, class_id long, state string, confidence double, det_id long, x_min double, y_min double, x_max double, y_max double"


def track(detections, frames, config: Config | None = None):
    """Tracks of every frame (columns of TRACKS) of ``frames`` (feed_id, seq) with its detection rows, if any; an
    ``epoch`` column of the frames resets at its changes."""
    from pyspark.sql import functions as F

    from frameloom.operators.folds import fold_rows

    config = config or Config()
    marks = frames.select("feed_id", "seq", *[c for c in ("epoch",) if c in frames.columns], F.lit(False).alias("detected"))
    found = detections.select("feed_id", "seq", "det_id", "class_id", "conf", "x_min", "y_min", "x_max", "y_max", F.lit(True).alias("detected"))
    rows = marks.unionByName(found, allowMissingColumns=True)
    return fold_rows(rows, ["feed_id"], ["seq", "detected", "det_id"], lambda: FeedTracker(config), lambda s, r: s.step(r), TRACKS, lambda s: s.flush())
