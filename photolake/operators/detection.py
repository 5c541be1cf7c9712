"""From raw detections to the faces of a photo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from photolake.functions.geometry import anchor, box_of, clip, iou, sigmoid, similarity, unletterbox


def decoded(raw: DataFrame, side: int, logits: bool = True) -> DataFrame:
    """Boxes in image pixels from detector outputs.

    ``raw`` has, for each anchor, its ``stride``, flat ``index``, ``score``, the distances ``d_left,
    d_top, d_right, d_bottom`` in strides, and the letterbox's ``scale, pad_x, pad_y``.
    """
    cells = F.lit(side) / F.col("stride")
    cx, cy = anchor(F.col("index"), F.floor(cells), F.col("stride"))
    box = box_of(cx, cy, F.col("stride"), *(F.col(c) for c in ("d_left", "d_top", "d_right", "d_bottom")))
    placed = {k: unletterbox(v, F.col("pad_x" if k[0] == "x" else "pad_y"), F.col("scale")) for k, v in box.items()}
    return raw.withColumns(placed | {"confidence": sigmoid(F.col("score")) if logits else F.col("score")})


def confident(faces: DataFrame, least: float) -> DataFrame:
    return faces.where((F.col("confidence") >= least) & ~F.isnan("confidence"))


def large_enough(faces: DataFrame, least: float) -> DataFrame:
    """Boxes whose shorter side, before clipping, is ``least`` or more."""
    return faces.where(F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= least)


def clipped(faces: DataFrame, width: Column, height: Column) -> DataFrame:
    return faces.withColumns({c: clip(F.col(c), width if c[0] == "x" else height) for c in ("x1", "y1", "x2", "y2")})


def suppressed(faces: DataFrame, photo: str, threshold: float, *keep: str) -> DataFrame:
    """Greedy suppression: by falling confidence, a box stays if no box that stays overlaps it more.

    ``keep`` are further columns to carry. The boxes of one photo are folded in one array; the
    detector bounds their number.
    """
    carried = ("x1", "y1", "x2", "y2", "confidence", *keep)
    # arrays sort upwards, so the order is by falling confidence through its negative
    face = F.struct((-F.col("confidence")).alias("falling"), F.col("face_ord"), *(F.col(c) for c in carried))
    grouped = faces.groupBy(photo).agg(F.sort_array(F.collect_list(face)).alias("boxes"))
    none = F.filter(F.col("boxes"), lambda b: F.lit(False))
    kept = F.aggregate("boxes", none, lambda done, b: F.when(F.exists(done, lambda k: iou(k, b) > threshold), done).otherwise(F.array_append(done, b)))
    return grouped.select(photo, F.inline(kept)).drop("falling")


def capped(faces: DataFrame, photo: str, most: int) -> DataFrame:
    """The ``most`` most confident faces of each photo."""
    rank = F.row_number().over(Window.partitionBy(photo).orderBy(F.col("confidence").desc(), "face_ord"))
    return faces.withColumn("rank", rank).where(F.col("rank") <= most)


def landmarks_inside(faces: DataFrame, points: str = "keypoints", first: int = 3) -> DataFrame:
    """Faces whose first landmarks, eyes and nose, lie in the box."""
    inside = lambda p: (p["x"] >= F.col("x1")) & (p["x"] <= F.col("x2")) & (p["y"] >= F.col("y1")) & (p["y"] <= F.col("y2"))
    return faces.where(F.forall(F.slice(points, 1, first), inside))


def aligned(faces: DataFrame, pairs: str) -> DataFrame:
    """``a, b, tx, ty`` of the least-squares transform of each row's points onto their targets.

    ``pairs`` is an array of structs ``x, y, u, v``. All four are null where the points fall together,
    and such faces are dropped by the caller.
    """
    terms = {"sx": "x", "sy": "y", "su": "u", "sv": "v"}
    total = lambda f: F.aggregate(F.transform(pairs, f), F.lit(0.0), lambda s, v: s + v)
    one = lambda c: lambda p: p[c]
    product = lambda i, j: lambda p: p[i] * p[j]
    sums = {n: total(one(c)) for n, c in terms.items()}
    sums |= {n: total(product(i, j)) for n, i, j in (("sxu", "x", "u"), ("syv", "y", "v"), ("sxv", "x", "v"), ("syu", "y", "u"))}
    sums["sq"] = total(lambda p: p["x"] * p["x"] + p["y"] * p["y"])
    summed = faces.withColumns({f"_{n}": c for n, c in sums.items()}).withColumn("_n", F.size(pairs).cast("double"))
    found = similarity(*(F.col(f"_{n}") for n in ("n", "sx", "sy", "su", "sv", "sxu", "syv", "sxv", "syu", "sq")))
    return summed.withColumns(found).drop("_n", *(f"_{n}" for n in sums))


def overlaps(faces: DataFrame, photo: str, threshold: float) -> DataFrame:
    """Pairs of boxes of one photo that overlap by more than ``threshold``."""
    box = F.struct("x1", "y1", "x2", "y2")
    a = faces.select(photo, F.col("face_ord").alias("a"), box.alias("box_a"))
    b = faces.select(photo, F.col("face_ord").alias("b"), box.alias("box_b"))
    return a.join(b, photo).where("a < b").withColumn("iou", iou(F.col("box_a"), F.col("box_b"))).where(F.col("iou") > threshold).select(photo, "a", "b", "iou")
