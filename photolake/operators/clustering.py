"""DBSCAN over vectors as joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from photolake.functions.vectors import cosine
from photolake.operators.components import connected_components
from photolake.operators.order import ranked
from photolake.storage import materialize

#: Vectors of each side that are compared with each other at once.
TILE = 4096
#: Groups that the vectors are cut into at least, where they are many, and numbers that the vectors of a group have at most.
GROUPS, NUMBERS = 16, 1 << 21
#: Rows of a group that are compared at once, and pairs of vectors, or rows and pivots, that are reckoned at once.
RUN, AT_ONCE = 128, 1 << 15
#: Pivots at most, vectors that they are chosen among, and groups whose spans are compared by one task.
PIVOTS, SAMPLE, SPANS = 512, 4096, 1024
#: About how many seconds a pair of vectors, a vector sent to a pair of groups, and such a pair cost.
PAIR_S, COPY_S, TILE_S = 2e-8, 5e-6, 3e-4


def _doubles(vectors: DataFrame) -> DataFrame:
    """``ord, embedding`` in doubles, without null and empty vectors."""
    return vectors.select("ord", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).where(F.size("embedding") > 0)


def _packed(classes: DataFrame) -> DataFrame:
    """``cid, n, size, vec``: vectors as bytes, written down; of floats where these hold the same numbers, else of doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [x.values.to_numpy(zero_copy_only=False).astype("<f8") for x in batch.column(2)]
            with np.errstate(all="ignore"):
                short = [x.astype("<f4") for x in data]
            vec = [(s if (s == x).all() else x).tobytes() for s, x in zip(short, data)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in data], pa.int32()), pa.array(vec, pa.binary())], ["cid", "n", "size", "vec"])

    kind = classes.schema["cid"].dataType.simpleString()
    return materialize(classes.select("cid", "n", "embedding").mapInArrow(pack, f"cid {kind}, n long, size int, vec binary"), "packed")


def _matrix(vectors: list[bytes], size: int) -> np.ndarray:
    """Packed vectors of one length as rows of doubles."""
    out = np.empty((len(vectors), size))
    for kind in ("<f4", "<f8"):
        of = [i for i, v in enumerate(vectors) if len(v) == size * int(kind[2])]
        out[of] = np.frombuffer(b"".join(vectors[i] for i in of), kind).reshape(len(of), size)
    return out


def pivots_of(packed: DataFrame, rows: int) -> np.ndarray:
    """Vectors that lie far apart, each the farthest from those before, among at most :data:`SAMPLE` of the smallest hashes.

    All have the length that most of the sample have. Which vectors are pivots decides how many pairs of
    groups are compared, and never the result.
    """
    some = [_matrix([r["vec"]], r["size"])[0] for r in packed.orderBy(F.xxhash64("cid")).limit(SAMPLE).select("vec", "size").collect()]
    some = [x for x in some if np.isfinite(x).all()]
    if not some:
        return np.empty((0, 0))
    lengths = [len(x) for x in some]
    size = max(sorted(set(lengths)), key=lengths.count)
    x = np.array([v for v in some if len(v) == size])
    chosen, away = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(len(x), PIVOTS, max(4, rows // 16)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def distances(vectors: list[bytes], sizes: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The distance of each vector from each pivot; not a number where the lengths differ or it has none."""
    out = np.full((len(vectors), len(pivots)), np.nan)
    fits = np.flatnonzero(sizes == pivots.shape[1])
    if len(fits) and len(pivots):
        x = _matrix([vectors[i] for i in fits], pivots.shape[1])
        with np.errstate(all="ignore"):
            out[fits] = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0))
    out[~np.isfinite(out).all(1)] = np.nan
    return out


def _slices(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches, cut small, with the distances of their vectors from the pivots."""
    rows = max(1, AT_ONCE * 8 // max(1, len(pivots)))
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            some = batch.slice(a, rows)
            yield some, distances(some.column("vec").to_pylist(), some.column("size").to_numpy(), pivots)


def group_rows(rows: int, pivots: np.ndarray) -> int:
    """Vectors of a group at most; pairs of groups are compared by one task each.

    Every vector is sent to all groups that its own meets, so few large groups send less; they are cut so
    that there are pairs for many tasks and that a task holds two of them.
    """
    return max(TILE, min(rows // GROUPS, NUMBERS // pivots.shape[1] if len(pivots) else 0))


def in_cells(packed: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``packed`` with the ``cell`` of each vector, the number of its nearest pivot, and its distance ``away``.

    Vectors without distances have a cell for each length, below 0.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, d in _slices(batches, pivots):
            known = np.isfinite(d).all(1) & (len(pivots) > 0)
            cell = -batch.column("size").to_numpy().astype(np.int64)
            away = np.zeros(len(cell))
            cell[known], away[known] = d[known].argmin(1), d[known].min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], [*batch.schema.names, "cell", "away"])

    schema = T.StructType([*packed.schema, T.StructField("cell", T.LongType()), T.StructField("away", T.DoubleType())])
    return packed.mapInArrow(place, schema)


def in_groups(placed: DataFrame, groups: dict[int, int], each: int) -> DataFrame:
    """``placed`` with the ``group`` of each vector: what ``groups`` has for its cell, cut by the distance from the pivot where it holds more than ``each``."""
    known = placed.sparkSession.createDataFrame(list(groups.items()) or [(0, 0)], "cell long, _group long")
    # a row for each cell
    grouped = placed.join(F.broadcast(known), "cell", "left").withColumn("group", F.shiftleft(F.coalesce("_group", "cell"), 32)).drop("_group", "cell")
    counts = materialize(grouped.groupBy("group").agg(F.count("*").alias("k")), "counts")
    if (counts.agg(F.max("k")).first()[0] or 0) <= each:
        return grouped.drop("away")
    bases = counts.select("group", F.coalesce(F.sum("k").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    found = ranked(grouped, "group", "away", "cid").join(F.broadcast(bases), "group")
    return found.withColumn("group", F.col("group") + F.floor((F.col("place") - F.col("base")) / each)).drop("away", "place", "base")


def _apart(sides: list[np.ndarray]) -> np.ndarray:
    """How far two sets of vectors are apart at least, from the spans ``low, high, low, high`` of both sets' groups."""
    gap = np.zeros((len(sides[0]), len(sides[2])))
    for low, high, low2, high2 in zip(*(m.T for m in sides)):
        gap = np.maximum(gap, np.maximum(low[:, None] - high2, low2 - high[:, None]))
    return gap


def _slack(eps: float, spans: list[np.ndarray]) -> float:
    """``eps``, a little wider against rounding of the distances."""
    most = max((np.abs(m[np.isfinite(m)]).max(initial=0) for m in spans), default=0)
    return eps + 1e-6 * (1 + eps + most)


def wide_enough(cells: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray, pivots: np.ndarray, eps: float, parts: int, each: int | None = None) -> tuple[dict[int, int], list[tuple[int, int]] | None]:
    """The group of each cell, and the pairs of groups that meet where none has to be cut: cells alone where most of them never meet, else several side by side together.

    Small groups leave out more pairs of vectors, but each vector is sent to every group that its own
    meets. Where the spans tell little, as with vectors that lie at random in many dimensions, few large
    groups are cheaper; so the cost of both, and of what is between, is reckoned from the spans. A group
    holds ``each`` vectors at most, or :data:`TILE`.
    """
    if not len(cells):
        return {}, None
    # cells near the same one of the first pivots stand side by side
    far = pivots[: max(1, int(len(pivots) ** 0.5))]
    beside = ((pivots[cells][:, None] - far) ** 2).sum(2).argmin(1) if len(pivots) else np.zeros(len(cells))
    order = np.lexsort((cells, beside))
    cells, counts, low, high = cells[order], counts[order], low[order], high[order]
    best: tuple = (np.inf, None, None)
    width = 1
    while width < 2 * len(cells):
        first = np.arange(0, len(cells), width)
        n = np.add.reduceat(counts, first)
        a, b = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        near = np.triu(_apart([a, b, a, b]) <= _slack(eps, [a, b]))
        # groups that hold more are cut, and their parts meet each other
        tiles = -(-n // (each or TILE))
        pairs, sent = (near * np.outer(tiles, tiles)).sum(), (near * (np.outer(n, tiles) + np.outer(tiles, n))).sum()
        cost = ((near * np.outer(n, n)).sum() * PAIR_S + sent * COPY_S + pairs * TILE_S) / min(max(pairs, 1), parts)
        if cost < best[0]:
            best = (cost, np.repeat(np.arange(len(first)), width)[: len(cells)], np.argwhere(near).tolist() if tiles.max() == 1 else None)
        width *= 2
    return dict(zip(cells.tolist(), best[1].tolist())), best[2]


def spans_of(grouped: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``group, size, low, high``: between which distances from each pivot a group's vectors lie."""

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch, d in _slices(batches, pivots):
            groups, sizes = batch.column("group").to_numpy(), batch.column("size").to_numpy()
            order = np.argsort(groups, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(groups[order]) != 0]) if len(groups) else []
            for some in np.split(order, starts[1:]):
                key = int(groups[some[0]]), int(sizes[some[0]])
                # where there is no distance nothing is known
                low, high = np.nan_to_num(d[some].min(0), nan=-np.inf), np.nan_to_num(d[some].max(0), nan=np.inf)
                a, b = held.get(key, (low, high))
                held[key] = np.minimum(a, low), np.maximum(b, high)
        if held:
            yield pa.RecordBatch.from_pylist([{"group": g, "size": n, "low": a.tolist(), "high": b.tolist()} for (g, n), (a, b) in held.items()], pa.schema([("group", pa.int64()), ("size", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))

    parts = grouped.select("group", "size", "vec").mapInArrow(span, "group long, size int, low array<double>, high array<double>")
    if not len(pivots):
        return parts.groupBy("group", "size").agg(F.first("low").alias("low"), F.first("high").alias("high"))
    each = parts.select("group", "size", F.posexplode(F.arrays_zip("low", "high")).alias("i", "x"))
    each = each.groupBy("group", "size", "i").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    # a number for each pivot
    lists = each.groupBy("group", "size").agg(F.sort_array(F.collect_list(F.struct("i", "low", "high"))).alias("x"))
    return lists.select("group", "size", F.col("x.low").alias("low"), F.col("x.high").alias("high"))


def meeting(spans: DataFrame, eps: float) -> DataFrame:
    """``one, two``: the pairs of groups (``one <= two``) that may hold vectors at most ``eps`` apart.

    The distances of two vectors from a pivot differ by no more than the vectors' own distance, so two
    groups never meet if their spans lie further apart than ``eps`` for any pivot. Spans with ``fresh``
    false are compared with fresh ones alone.
    """
    if "fresh" not in spans.columns:
        spans = spans.withColumn("fresh", F.lit(True))
    spans = materialize(spans.select("group", "size", "low", "high", "fresh"), "spans")
    blocks = max(1, -(-spans.count() // SPANS))
    block = F.pmod(F.xxhash64("group"), F.lit(blocks)).cast("int")
    spread = spans.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread = spread.select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "group", "size", "low", "high", "fresh")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows["x"].iloc[0], rows["y"].iloc[0]
        a, b = rows[rows["block"] == x], rows[rows["block"] == y]
        sides = [np.array([*some[c]]).reshape(len(some), -1) for some in (a, b) for c in ("low", "high")]
        near = (_apart(sides) <= _slack(eps, sides)) & (a["size"].to_numpy()[:, None] == b["size"].to_numpy())
        near &= a["fresh"].to_numpy()[:, None] | b["fresh"].to_numpy()
        one, two = a["group"].to_numpy()[:, None], b["group"].to_numpy()
        if x == y:
            near &= one <= two
        i, j = np.nonzero(near)
        left, right = one[i, 0], two[j]
        return pd.DataFrame({"one": np.minimum(left, right), "two": np.maximum(left, right)})

    return spread.groupBy("x", "y").applyInPandas(meet, "one long, two long")


def _grouped(packed: DataFrame, eps: float) -> tuple[DataFrame, DataFrame]:
    """``packed`` with the ``group`` of each vector, and the pairs of groups that have to be compared, both written down.

    Vectors go to the nearest of some pivots; groups whose spans of distances from any of the pivots lie
    too far apart are not compared (:func:`meeting`). The driver sees the sample of pivots and the spans
    of their cells, :data:`PIVOTS` rows at most.
    """
    spark, rows = packed.sparkSession, packed.count()
    pivots = pivots_of(packed, rows)
    each = group_rows(rows, pivots)
    placed = materialize(in_cells(packed, pivots), "placed")
    cells = placed.withColumn("group", F.col("cell"))
    spans = spans_of(cells, pivots).join(cells.groupBy("group").agg(F.count("*").alias("k")), "group").orderBy("group")
    # a row for each pivot, and for each length of vectors that have no distances, for which no span is taken
    known = spans.where("group >= 0").collect() if len(pivots) else []
    of = [np.array([r[c] for r in known]) for c in ("group", "k", "low", "high")]
    groups, pairs = wide_enough(*of, pivots, eps, int(spark.conf.get("spark.sql.shuffle.partitions")), each)
    if pairs is not None and placed.where("cell < 0").isEmpty():
        numbers = [F.lit(x) for pair in groups.items() for x in pair]
        grouped = placed.withColumn("group", F.shiftleft(F.create_map(*numbers)[F.col("cell")].cast("long"), 32)).drop("cell", "away")
        return grouped, spark.createDataFrame([(a << 32, b << 32) for a, b in pairs], "one long, two long")
    grouped = materialize(in_groups(placed, groups, each), "grouped")
    return grouped, materialize(meeting(spans_of(grouped, pivots), eps), "meeting")


def share_met(vectors: DataFrame, eps: float) -> float:
    """The share of all pairs of groups that :func:`neighbours` and :func:`dbscan` have to compare."""
    grouped, pairs = _grouped(_packed(_doubles(vectors).select(F.col("ord").alias("cid"), F.lit(1).cast("long").alias("n"), "embedding")), eps)
    n = grouped.select("group").distinct().count()
    return pairs.count() / max(1, n * (n + 1) // 2)


def _tiles(grouped: DataFrame, pairs: DataFrame, *carried: str) -> DataFrame:
    """Rows dealt to the pairs of groups ``one, two`` that they are compared in: ``one, two, second, cid, n, size, vec``."""
    parts = int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first, second = (F.struct(F.col(c).alias("group"), F.lit(c == "two").alias("second")) for c in ("one", "two"))
    sides = F.when(F.col("one") == F.col("two"), F.array(first)).otherwise(F.array(first, second))
    met = pairs.select("one", "two", F.inline(sides))
    met = grouped.join(met, "group").select("one", "two", "second", "cid", "n", "size", "vec", *carried)
    return met.repartition(parts, "one", "two").sortWithinPartitions("one", "two", "second", "cid")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each tile and length of vectors: whether both sides are the same rows, the rows of both as columns, and their vectors.

    A pair of groups is cut into tiles of at most :data:`TILE` rows a side; of a group and itself each
    pair of rows is in one tile.
    """

    def tables() -> Iterator[pa.Table]:
        left: list = []
        for batch in batches:
            one, two = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(one) != 0) | (np.diff(two) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                some = batch.slice(a, b - a)
                if left and (left[0].column(0)[0] != some.column(0)[0] or left[0].column(1)[0] != some.column(1)[0]):
                    yield pa.Table.from_batches(left)
                    left = []
                left.append(some)
        if left:
            yield pa.Table.from_batches(left)

    for t in tables():
        alone = t.column("one")[0] == t.column("two")[0]
        sizes = t.column("size").to_numpy()
        for size in np.unique(sizes).tolist():
            mine = t if (sizes == size).all() else t.filter(pa.array(sizes == size))
            # the first side's rows come first, so no vectors are copied
            n = mine.num_rows - int(mine.column("second").to_numpy().sum())
            a = mine.slice(0, n)
            b = a if alone else mine.slice(n)
            if not a.num_rows or not b.num_rows:
                continue
            for i in range(0, a.num_rows, TILE):
                p = a.slice(i, TILE)
                x = _matrix(p.column("vec").to_pylist(), size)
                for j in range(i if alone else 0, b.num_rows, TILE):
                    q = b.slice(j, TILE)
                    same = alone and i == j
                    yield same, p, q, x, x if same else _matrix(q.column("vec").to_pylist(), size)


def _squared(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of rows ``p`` of ``x`` from rows ``q`` of ``y``, some at once."""
    out, each = np.empty(len(p)), max(1, AT_ONCE * 8 // max(1, x.shape[1]))
    for i in range(0, len(p), each):
        out[i : i + each] = ((x[p[i : i + each]] - y[q[i : i + each]]) ** 2).sum(1)
    return out


def _near(alone: bool, x: np.ndarray, y: np.ndarray, eps: float) -> Iterator[tuple[int, np.ndarray]]:
    """For :data:`RUN` rows of ``x`` at a time, the first of them and to which rows of ``y`` each is near; a row is never near itself."""
    with np.errstate(all="ignore"):
        xx, yy = (x * x).sum(1), (y * y).sum(1)
    for i in range(0, len(x), RUN):
        xs, own = x[i : i + RUN], xx[i : i + RUN]
        with np.errstate(all="ignore"):
            rough = xs @ y.T
            rough *= -2
            rough += own[:, None]
            rough += yy
            # squares are that large at most, and rounding is a part of them
            most = sum(s[np.isfinite(s)].max(initial=0) for s in (own, yy))
            slack = 1e-9 * (1 + eps * eps + most)
            near = rough <= eps * eps
            rough -= eps * eps
            # what rounding may decide is summed up anew
            p, q = np.nonzero(np.abs(rough, out=rough) <= slack)
        del rough
        near[p, q] = _squared(xs, y, p, q) <= eps * eps
        if alone:
            near[np.arange(len(xs)), i + np.arange(len(xs))] = False
        yield i, near


def _roots(near: np.ndarray, core: list, alone: bool) -> list:
    """For the core rows of both sides, the first row of their component among these; -1 for others.

    Rows of the second side are counted on behind those of the first.
    """
    sides = [np.full(len(c), -1) for c in core]
    if alone:
        sides[1] = sides[0]
    steps = (near,) if alone else (near, near.T)
    for k in range(len(steps)):
        for start in np.flatnonzero(core[k]).tolist():
            if sides[k][start] >= 0:
                continue
            name = start + (len(core[0]) if k else 0)
            sides[k][start] = name
            at, front = k, np.array([start])
            while len(front):
                to = 0 if alone else 1 - at
                front = np.flatnonzero(steps[at][front].any(0) & core[to] & (sides[to] < 0))
                sides[to][front] = name
                at = to
    return sides


def _counted(eps: float) -> Callable:
    """Tiles to ``cid, k``: how many rows of the other side are near, by the numbers ``n`` that each stands for."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for alone, a, b, x, y in _met(batches):
            n, m = (side.column("n").to_numpy().astype(np.int64) for side in (a, b))
            found = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
            for i, near in _near(alone, x, y, eps):
                found[0][i : i + RUN] = near @ m
                if not alone:
                    found[1][:] += n[i : i + RUN] @ near
            for side, k in zip((a, b), found[: 1 if alone else 2]):
                yield pa.RecordBatch.from_arrays([side.column("cid").combine_chunks(), pa.array(k)], ["cid", "k"])

    return count


def _linked(eps: float, asking: str | None = None) -> Callable:
    """Tiles to ``a, b, inner``: links that join the core rows near each other, and each core component next to another row.

    Of core rows that hang together in a tile each is linked to one of them alone. With ``asking`` only
    pairs count of which that column holds for one row at least.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for alone, a, b, x, y in _met(batches):
            ids = [np.array(side.column("cid").to_pylist()) for side in (a, b)]
            core = [np.array(side.column("core").to_pylist(), bool) for side in (a, b)]
            near = np.empty((len(x), len(y)), bool)
            for i, some in _near(alone, x, y, eps):
                near[i : i + RUN] = some
            if asking:
                asks = [np.array(side.column(asking).to_pylist(), bool) for side in (a, b)]
                near[~asks[0]] &= asks[1]
            root = _roots(near, core, alone)
            heads = np.concatenate(ids)
            out: list = []
            for k in (0,) if alone else (0, 1):
                here, there = (near, root[1]) if k == 0 else (near.T, root[0])
                linked = np.flatnonzero(core[k] & (root[k] >= 0))
                out.append((heads[root[k][linked]], ids[k][linked], np.ones(len(linked), bool)))
                for i in np.flatnonzero(~core[k]).tolist():
                    beside = np.unique(there[here[i] & (there >= 0)])
                    out.append((heads[beside], np.repeat(ids[k][i : i + 1], len(beside)), np.zeros(len(beside), bool)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in range(3)], ["a", "b", "inner"])

    return link


def neighbours(vectors: DataFrame, eps: float) -> DataFrame:
    """Pairs ``a < b`` (``ord``) of vectors (``ord, embedding``) at most ``eps`` apart, with ``d2``.

    All pairs are the result here, as many as there are. Vectors are compared in double precision by
    pairs of groups (:func:`_grouped`). Null and empty vectors are near nothing.
    """
    kind = vectors.schema["ord"].dataType.simpleString()
    # every row is a vector of its own
    packed = _packed(_doubles(vectors).select(F.col("ord").alias("cid"), F.lit(1).cast("long").alias("n"), "embedding"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for alone, a, b, x, y in _met(batches):
            ids, others = (np.array(side.column("cid").to_pylist()) for side in (a, b))
            for i, near in _near(alone, x, y, eps):
                rows, columns = np.nonzero(np.triu(near, i + 1) if alone else near)
                # many may be near, so some are sent at a time
                for at in range(0, len(rows), AT_ONCE):
                    p, q = i + rows[at : at + AT_ONCE], columns[at : at + AT_ONCE]
                    one, two = ids[p], others[q]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(_squared(x, y, p, q))], ["a", "b", "d2"])

    return _tiles(*_grouped(packed, eps)).mapInArrow(compare, f"a {kind}, b {kind}, d2 double")


def dbscan(vectors: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """``ord, degree, cluster_id``: labels of the sequential algorithm, whatever the partitioning.

    ``degree`` counts the vector itself. Core vectors have ``min_samples`` or more; their components
    are numbered by their smallest core; a border vector goes to the smallest number next to it, and
    the rest, noise, has null.

    Equal vectors take part as one. Pairs of groups are compared twice: first only numbers of
    neighbours leave a task, then the links that its core vectors' components need, one for each
    vector, and one for each such component next to a border vector. Pairs are never written out.
    """
    kind = vectors.schema["ord"].dataType.simpleString()
    doubles = _doubles(vectors)
    classes = materialize(doubles.groupBy("embedding").agg(F.min("ord").alias("cid"), F.count("*").alias("n")), "classes")
    packed = _packed(classes)
    grouped, pairs = _grouped(packed, eps)

    counts = _tiles(grouped, pairs).mapInArrow(_counted(eps), f"cid {kind}, k long").groupBy("cid").agg(F.sum("k").alias("k"))
    degree = materialize(packed.select("cid", "n").join(counts, "cid", "left").select("cid", (F.col("n") + F.coalesce("k", F.lit(0))).alias("degree")), "degrees")
    marked = grouped.join(degree.select("cid", (F.col("degree") >= min_samples).alias("core")), "cid")

    links = materialize(_tiles(marked, pairs, "core").mapInArrow(_linked(eps), f"a {kind}, b {kind}, inner boolean"), "links")
    joined = connected_components(links.where("inner and a <> b"))
    core = degree.where(F.col("degree") >= min_samples).select("cid")
    rooted = core.join(joined, F.col("cid") == F.col("node"), "left").select("cid", F.coalesce("component", "cid").alias("root"))
    numbers = ranked(rooted.select("root").distinct(), "root", name="cluster_id")
    labels = materialize(rooted.join(numbers, "root").select("cid", "cluster_id"), "cores")
    beside = links.where("not inner").join(labels.withColumnRenamed("cid", "a"), "a").groupBy(F.col("b").alias("cid")).agg(F.min("cluster_id").alias("near"))
    found = degree.join(labels, "cid", "left").join(beside, "cid", "left").select("cid", "degree", F.coalesce("cluster_id", "near").alias("cluster_id"))
    if classes.where("n > 1").isEmpty():
        of = found.withColumnRenamed("cid", "ord")
    else:
        of = doubles.join(classes.drop("n"), "embedding").select("ord", "cid").join(found, "cid")
    return vectors.select("ord").join(of, "ord", "left").select("ord", F.coalesce("degree", F.lit(1)).cast("long").alias("degree"), "cluster_id")


def consecutive_duplicates(vectors: DataFrame, least: float) -> DataFrame:
    """Vectors (``ord, embedding, score``) whose cosine with the one before is over ``least``.

    ``loser`` is the one of the pair with the lower score, the later one of equals.
    """
    placed = materialize(ranked(vectors.select("ord", "embedding", "score"), "ord"), "places")
    before = placed.select((F.col("place") + 1).alias("place"), F.col("ord").alias("previous"), F.col("embedding").alias("v"), F.col("score").alias("s"))
    found = placed.join(before, "place").withColumn("cosine", cosine(F.col("v"), F.col("embedding"))).where(F.col("cosine") > least)
    return found.select("previous", "ord", "cosine", F.when(F.col("score") > F.col("s"), F.col("previous")).otherwise(F.col("ord")).alias("loser"))
