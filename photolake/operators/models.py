"""Face detection and embedding: ONNX models inside tasks, everything after them in columns.

The detector's task letterboxes a picture, runs the model and emits the anchors over a floor of
confidence as rows; the embedder's warps each face onto the template and runs the model. Decoding of
anchors, gates, suppression and caps are DataFrame operations of :mod:`photolake.operators.detection`.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from photolake.config import Config
from photolake.errors import InferenceFailure, told
from photolake.functions.geometry import unletterbox
from photolake.functions.images import rgb_of, smooth
from photolake.operators import detection

# Where eyes, nose and corners of the mouth stand in an aligned face of 112 x 112.
TEMPLATE = [(38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041)]
FACE_SIDE = 112
STRIDES = (8, 16, 32)

RAW = "path string, width int, height int, stride int, index int, score double, d_left double, d_top double, d_right double, d_bottom double, points array<double>, scale double, pad_x double, pad_y double, error string"
EMBEDDED = "path string, face_ord int, embedding array<float>, error string"

_SESSIONS: dict = {}


def available(*models: str) -> bool:
    """Whether the model files are there; without them detection is skipped."""
    return all(os.path.exists(m) for m in models)


def _session(path: str):
    if path not in _SESSIONS:
        import onnxruntime

        _SESSIONS[path] = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
    return _SESSIONS[path]


def letterboxed(rgb: np.ndarray, side: int) -> tuple[np.ndarray, float, int, int]:
    """The picture in the middle of a black square, as the detector's input, with scale and padding."""
    scale = min(side / rgb.shape[1], side / rgb.shape[0])
    width, height = max(1, int(rgb.shape[1] * scale)), max(1, int(rgb.shape[0] * scale))
    left, top = (side - width) // 2, (side - height) // 2
    square = np.zeros((side, side, 3), np.float32)
    square[top : top + height, left : left + width] = smooth(rgb, height, width)
    return ((square - 127.5) / 128).transpose(2, 0, 1)[None].astype(np.float32), scale, left, top


def split_outputs(outputs: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Scores, distances and landmarks of each stride, told apart by their last side and their length."""
    by_width = {w: sorted((o.reshape(-1, w) for o in outputs if o.shape[-1] == w), key=len, reverse=True) for w in (1, 4, 10)}
    if any(len(x) != len(STRIDES) for x in by_width.values()):
        raise ValueError(f"outputs of shapes {[o.shape for o in outputs]}")
    return [(s[:, 0], d, p) for s, d, p in zip(by_width[1], by_width[4], by_width[10])]


def raw_detections(images: DataFrame, model: str, config: Config = Config(), run=None) -> DataFrame:
    """:data:`RAW` rows of the anchors that can pass the gate; ``run`` stands in for the model in tests."""
    side, least = config.detector_size, config.min_confidence
    floor = math.log(least / (1 - least)) if config.scores_are_logits else least

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        infer = run
        if infer is None:
            session = _session(model)
            infer = lambda x: session.run(None, {session.get_inputs()[0].name: x})
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                size = (row["path"], row["width"], row["height"])
                try:
                    x, scale, left, top = letterboxed(rgb_of(row["pixels"], row["width"], row["height"], row["channels"]), side)
                    for stride, (scores, distances, points) in zip(STRIDES, split_outputs(infer(x))):
                        for i in np.flatnonzero(scores >= floor - 1e-6).tolist():
                            out.append((*size, stride, i, float(scores[i]), *map(float, distances[i]), points[i].astype(float).tolist(), scale, float(left), float(top), None))
                except Exception as x:  # whatever a model raises, other photos are searched
                    out.append((*size, *[None] * 11, told(InferenceFailure, x)))
            kinds = [pa.string(), *[pa.int32()] * 4, *[pa.float64()] * 5, pa.list_(pa.float64()), *[pa.float64()] * 3, pa.string()]
            columns = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [c.split()[0] for c in RAW.split(", ")])

    return images.select("path", "width", "height", "channels", "pixels").mapInArrow(find, RAW)


def found_faces(raw: DataFrame, config: Config = Config()) -> DataFrame:
    """Faces by photo: decoded, gated by confidence and size, clipped, suppressed and capped.

    ``path, face_ord, x1, y1, x2, y2, confidence, keypoints``, the surest first.
    """
    boxes = detection.decoded(raw.where("error is null"), config.detector_size, config.scores_are_logits)
    cells = F.floor(F.lit(config.detector_size) / F.col("stride"))
    cell = F.floor(F.col("index") / 2)
    cx, cy = (cell % cells + 0.5) * F.col("stride"), (F.floor(cell / cells) + 0.5) * F.col("stride")
    at = lambda i: F.get("points", i) * F.col("stride")
    point = lambda k: F.struct(unletterbox(cx + at(2 * k), F.col("pad_x"), F.col("scale")).alias("x"), unletterbox(cy + at(2 * k + 1), F.col("pad_y"), F.col("scale")).alias("y"))
    boxes = boxes.withColumn("keypoints", F.transform(F.sequence(F.lit(0), F.lit(4)), point))
    gated = detection.large_enough(detection.confident(boxes, config.min_confidence), config.min_face_size)
    clipped = detection.clipped(gated, F.col("width").cast("double"), F.col("height").cast("double"))
    numbered = clipped.withColumn("face_ord", F.row_number().over(Window.partitionBy("path").orderBy(F.col("confidence").desc(), "stride", "index")) - 1)
    kept = detection.capped(detection.suppressed(numbered, "path", config.nms_threshold, "keypoints"), "path", config.max_faces)
    return kept.withColumn("face_ord", F.col("rank") - 1).select("path", "face_ord", "x1", "y1", "x2", "y2", "confidence", "keypoints")


def warped(rgb: np.ndarray, a: float, b: float, tx: float, ty: float, side: int) -> np.ndarray:
    """The square of ``side`` pixels that the inverse transform reads from the picture, between four pixels each."""
    y, x = np.mgrid[:side, :side].astype(np.float64)
    at_x = np.clip(a * x - b * y + tx, 0, max(rgb.shape[1] - 1.001, 0))
    at_y = np.clip(b * x + a * y + ty, 0, max(rgb.shape[0] - 1.001, 0))
    left, top = at_x.astype(int), at_y.astype(int)
    right, below = np.minimum(left + 1, rgb.shape[1] - 1), np.minimum(top + 1, rgb.shape[0] - 1)
    u, v = (at_x - left)[..., None], (at_y - top)[..., None]
    upper = rgb[top, left] * (1 - u) + rgb[top, right] * u
    lower = rgb[below, left] * (1 - u) + rgb[below, right] * u
    return np.clip(np.rint(upper * (1 - v) + lower * v), 0, 255).astype(np.uint8)


def transforms(faces: DataFrame) -> DataFrame:
    """Faces with ``ia, ib, itx, ity``, which lead from the aligned square into the picture; null if there is none."""
    from photolake.functions.geometry import inverse_similarity

    template = F.array(*(F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v in TEMPLATE))
    pairs = F.zip_with("keypoints", template, lambda p, t: F.struct(p["x"].alias("x"), p["y"].alias("y"), t["u"].alias("u"), t["v"].alias("v")))
    found = detection.aligned(faces.withColumn("pairs", pairs), "pairs").drop("pairs")
    return found.withColumns(inverse_similarity(*(F.col(c) for c in ("a", "b", "tx", "ty")))).drop("a", "b", "tx", "ty")


def embedded(images: DataFrame, faces: DataFrame, model: str, run=None) -> DataFrame:
    """:data:`EMBEDDED` rows; each picture is decoded once for all of its faces, whose number is capped.

    A face whose landmarks fall together has no transform and is dropped; one that fails has an error.
    """
    wanted = transforms(faces).where("ia is not null").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("face_ord", "ia", "ib", "itx", "ity"))).alias("faces"))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        infer = run
        if infer is None:
            session = _session(model)
            infer = lambda x: session.run(None, {session.get_inputs()[0].name: x})[0]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for f in row["faces"]:
                    try:
                        rgb = rgb_of(row["pixels"], row["width"], row["height"], row["channels"])
                        square = warped(rgb, f["ia"], f["ib"], f["itx"], f["ity"], FACE_SIDE)
                        v = np.asarray(infer(((square.astype(np.float32) - 127.5) / 127.5).transpose(2, 0, 1)[None])).ravel()
                        norm = float(np.sqrt((v * v).sum()))
                        out.append((row["path"], f["face_ord"], (v / norm if norm > 0 else v).astype(np.float32).tolist(), None))
                    except Exception as x:  # whatever a model raises, other faces are embedded
                        out.append((row["path"], f["face_ord"], None, told(InferenceFailure, x)))
            kinds = [pa.string(), pa.int32(), pa.list_(pa.float32()), pa.string()]
            columns = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["path", "face_ord", "embedding", "error"])

    both = images.join(wanted, "path").select("path", "width", "height", "channels", "pixels", "faces")
    return both.mapInArrow(embed, EMBEDDED)
