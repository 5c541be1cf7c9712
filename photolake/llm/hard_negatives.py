"""Hard negatives found with a vector-approximation file (Weber et al., VLDB 1998).

Rows are dealt into blocks; a block's vectors are quantised, each dimension into cells that hold equally
many of them, one byte for each. A row's score with an anchor then lies between two sums of cell edges
looked up in the block's table, and only rows whose bounds let them into a top list, or into a window
of scores, are scored exactly. Anchors go to every block; a block hands back its best few for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from photolake.llm.tables import table
from photolake.storage import materialize

#: Cells of a dimension.
CELLS = 256
#: Rows of a block at most, rows bounded at once, anchors taken at once, and pairs scored at once.
BLOCK, RUN, CHUNK, PAIRS = 1 << 16, 2048, 256, 1 << 15
#: Whole numbers up to here are exact in double precision.
EXACT = 1 << 53


class Approximations:
    """Vectors of one length (whole numbers, one a row) as cells, and the edges of the cells."""

    def __init__(self, vectors: np.ndarray) -> None:
        n, size = vectors.shape
        cell = np.arange(n) * CELLS // n
        order = np.argsort(vectors, axis=0, kind="stable")
        self.codes = np.empty((n, size), np.uint8)
        np.put_along_axis(self.codes, order, np.broadcast_to(cell[:, None], (n, size)).astype(np.uint8), axis=0)
        ranked = np.take_along_axis(vectors, order, axis=0)
        first = np.searchsorted(cell, np.arange(CELLS))
        last = np.searchsorted(cell, np.arange(CELLS), "right") - 1
        # of a cell without rows nothing is ever looked up
        self.low, self.high = ranked[np.minimum(first, n - 1)].astype(float), ranked[np.maximum(last, 0)].astype(float)
        self.vectors, self.most = vectors, int(np.abs(vectors.astype(float)).max(initial=0))

    def bounds(self, rows: slice | np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest scores that the cells of ``rows`` leave open, a column for each anchor."""
        if not exact(self.most, anchors):
            shape = len(self.codes[rows]), len(anchors)
            return np.full(shape, -np.inf), np.full(shape, np.inf)
        codes, dims = self.codes[rows], np.arange(self.codes.shape[1])
        low, high = self.low[codes, dims], self.high[codes, dims]
        up, down = np.maximum(anchors, 0).T.astype(float), np.minimum(anchors, 0).T.astype(float)
        return low @ up + high @ down, high @ up + low @ down

    def scores(self, rows: np.ndarray, anchors: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Exact scores of pairs of rows and anchors; what a long cannot hold becomes the nearest long."""
        kind = float if exact(self.most, anchors) else object
        out = [np.einsum("ij,ij->i", self.vectors[rows[i : i + PAIRS]].astype(kind), anchors[of[i : i + PAIRS]].astype(kind)) if kind is float else (self.vectors[rows[i : i + PAIRS]].astype(object) * anchors[of[i : i + PAIRS]].astype(object)).sum(1) for i in range(0, len(rows), PAIRS)]
        if kind is object:
            out = [np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in part], np.int64) for part in out]
        return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def exact(most: int, anchors: np.ndarray) -> bool:
    """Whether all sums of products stay whole in double precision."""
    return most * int(np.abs(anchors.astype(float)).max(initial=0)) * max(1, anchors.shape[1]) < EXACT


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Which entries are among the first ``n`` of their group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, int)
    place = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[place < n]


def _kth(held: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The greatest ``len(held)`` of ``held`` and ``more`` in each column."""
    n = len(held)
    both = np.vstack([held, more])
    return np.partition(both, len(both) - n, axis=0)[len(both) - n :]


def nearest(index: Approximations, ids: np.ndarray, anchors: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor its first ``n`` rows of other ids: ``anchor, row, score``."""
    tops = np.full((n, len(anchors)), -np.inf)
    found = [np.empty(0, np.int64)] * 3
    for start in range(0, len(ids), RUN):
        rows = slice(start, start + RUN)
        low, high = index.bounds(rows, anchors)
        other = ids[rows, None] != own[None]
        tops = _kth(tops, np.where(other, low, -np.inf))
        i, j = np.nonzero(other & (high >= tops.min(0)))
        found = _kept(found, j, i + start, index.scores(i + start, anchors, j), ids, n)
    return tuple(found)


def _kept(found: list, group: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> list:
    both = [np.concatenate(x) for x in zip(found, (group, row, score))]
    chosen = best(both[0], both[2], ids[both[1]], n)
    return [x[chosen] for x in both]


def in_windows(index: Approximations, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, own: np.ndarray, windows: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window (``least, most`` score, of the anchor ``of``) its first ``n`` rows of other labels: ``window, row, score``."""
    least, most = windows.T.astype(float)
    tops = np.full((n, len(windows)), -np.inf)
    found = [np.empty(0, np.int64)] * 3
    for start in range(0, len(ids), RUN):
        rows = slice(start, start + RUN)
        low, high = index.bounds(rows, anchors)
        other, low, high = (labels[rows, None] != own[None])[:, of], low[:, of], high[:, of]
        # rows that are in the window for certain tell what the others have to reach
        tops = _kth(tops, np.where(other & (low >= least) & (high <= most), low, -np.inf))
        i, w = np.nonzero(other & (high >= np.maximum(least, tops.min(0))) & (low <= most))
        if not len(i):
            continue
        pair, back = np.unique(i * len(anchors) + of[w], return_inverse=True)
        score = index.scores(pair // len(anchors) + start, anchors, pair % len(anchors))[back]
        inside = (score >= windows[w, 0]) & (score <= windows[w, 1])
        found = _kept(found, w[inside], i[inside] + start, score[inside], ids, n)
    return tuple(found)


class _Block:
    """Rows of a block by length, and by label where asked for, each with its approximations once it is used."""

    def __init__(self, ids: list, labels: list, vectors: list) -> None:
        lengths = np.array([len(x) for x in vectors])
        self.parts = {}
        for size in set(lengths.tolist()):
            at = np.flatnonzero(lengths == size)
            at = at[np.argsort(np.array([ids[i] for i in at]), kind="stable")]
            self.parts[size] = (np.array([ids[i] for i in at]), np.array([labels[i] for i in at]), np.array([vectors[i] for i in at], np.int64).reshape(len(at), size))
        self.made: dict = {}

    def part(self, size: int, label: object = None) -> tuple[Approximations, np.ndarray, np.ndarray] | None:
        if (size, label) not in self.made:
            found = self.parts.get(size)
            if found is not None and label is not None:
                mine = found[1] == label
                found = tuple(x[mine] for x in found) if mine.any() else None
            self.made[size, label] = found and (Approximations(found[2]), found[0], found[1])
        return self.made[size, label]


def _positives(block: _Block, chunk: list[dict], n: int) -> Iterator[tuple]:
    groups: dict = {}
    for a in chunk:
        groups.setdefault((len(a["vec"]), a["label"]), []).append(a)
    for (size, label), some in groups.items():
        part = block.part(size, label)
        if part is None:
            continue
        index, ids, _ = part
        anchors = np.array([a["vec"] for a in some], np.int64).reshape(len(some), size)
        for j, i, score in zip(*(x.tolist() for x in nearest(index, ids, anchors, np.array([a["id"] for a in some]), n))):
            yield some[j]["no"], some[j]["id"], ids[i].item(), score, None, None, None


def _negatives(block: _Block, chunk: list[dict], n: int, share: tuple[int, int]) -> Iterator[tuple]:
    groups: dict = {}
    for a in chunk:
        groups.setdefault(len(a["vec"]), []).append(a)
    for size, some in groups.items():
        part = block.part(size)
        wanted = [(j, p) for j, a in enumerate(some) for p in a["positives"] if p["score"] >= 0]
        if part is None or not wanted:
            continue
        index, ids, labels = part
        anchors = np.array([a["vec"] for a in some], np.int64).reshape(len(some), size)
        windows = np.array([(-(-share[0] * p["score"] // share[1]), p["score"]) for _, p in wanted], np.int64)
        own = np.array([a["label"] for a in some])
        for w, i, score in zip(*(x.tolist() for x in in_windows(index, ids, labels, anchors, own, windows, np.array([j for j, _ in wanted]), n))):
            j, p = wanted[w]
            yield some[j]["no"], some[j]["id"], ids[i].item(), score, p["place"], p["id"], p["score"]


def _scan(rows: DataFrame, anchors: DataFrame, blocks: int, find: Callable[[_Block, list[dict]], Iterator[tuple]]) -> DataFrame:
    """``no, anchor_id, id, score, place, positive_id, positive_score``: what ``find`` finds for all anchors in each block."""
    kind = rows.schema["id"].dataType.simpleString()
    places = f"array<struct<place:int,score:bigint,id:{kind}>>"
    if "positives" not in anchors.columns:
        anchors = anchors.withColumn("positives", F.lit(None).cast(places))
    here = rows.select(F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("no"), "id", "label", "vec", F.lit(None).cast(places).alias("positives"))
    there = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "no", "id", "label", "vec", "positives")
    names = ["no", "anchor_id", "id", "score", "place", "positive_id", "positive_score"]
    schema = f"no long, anchor_id {kind}, id {kind}, score long, place int, positive_id {kind}, positive_score long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine, block, chunk = None, [], None, []

        def asked() -> Iterator[pa.RecordBatch]:
            out = list(find(block, chunk)) if block else []
            chunk.clear()
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], types)

        types = None
        for batch in batches:
            if types is None:
                of = batch.schema.field("id").type
                types = pa.schema([("no", pa.int64()), ("anchor_id", of), ("id", of), ("score", pa.int64()), ("place", pa.int32()), ("positive_id", of), ("positive_score", pa.int64())])
            asks, numbers = batch.column("asks").to_numpy(), batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(asks) != 0) | (np.diff(numbers) != 0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if numbers[start] != at:
                    yield from asked()
                    at, mine, block = numbers[start], [], None
                some = batch.slice(start, end - start)
                vectors = [x.values.to_numpy() for x in some.column("vec")]
                if not asks[start]:
                    mine.extend(zip(some.column("id").to_pylist(), some.column("label").to_pylist(), vectors))
                    continue
                if block is None and mine:
                    block, mine = _Block(*map(list, zip(*mine))), []
                told = some.drop_columns(["vec"]).to_pylist()
                for a, v in zip(told, vectors):
                    chunk.append(a | {"vec": v})
                    if len(chunk) == CHUNK:
                        yield from asked()
        yield from asked()

    dealt = here.unionAll(there).repartition(blocks, "block").sortWithinPartitions("block", "asks")
    return dealt.mapInArrow(scan, schema)


def mine(rows: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``id, label`` and ``vec``, whole numbers (``array<long>``); a score is an inner product.
    Anchors are the rows for which ``anchor`` holds. The first ``n_positives`` other rows of an anchor's
    label are its positives; for each, the first ``n_negatives`` rows of other labels are given whose
    score is ``share`` of the positive's or more, and not above it. Higher scores come first, then
    smaller ids. Everything is exact; what the bounds leave out cannot be among the first.

    Rows with a null id, label or vector take no part, nor do vectors with a null in them. Rows equal in
    all three count once; rows that only share an id are rows of their own, but none is an anchor's
    positive under the anchor's own id. Vectors of different lengths have no score. An anchor without
    positives, and a positive with a score below 0, gives no rows. Components and scores that a long
    cannot hold are the nearest long. Other columns are not read; an empty table gives no rows.

    Of equal vectors of one label only the ``n + 1`` smallest ids can be among the first, so a large
    group of copies is a few rows; as anchors all of them stay.
    """
    spark = rows.sparkSession
    good = rows.select("id", "label", "vec").where("id is not null and label is not null and vec is not null").where(F.forall("vec", lambda x: x.isNotNull()))
    good = materialize(good.withColumn("hash", F.xxhash64("vec")), "rows")
    ranked = good.withColumn("copy", F.dense_rank().over(Window.partitionBy("label", "hash", "vec").orderBy("id")))
    kept = ranked.where(F.col("copy") <= max(n_positives, n_negatives) + 1).dropDuplicates(["label", "hash", "vec", "id"]).select("id", "label", "vec")
    kept = materialize(kept, "kept")
    anchors = good.where(anchor).dropDuplicates(["label", "hash", "vec", "id"]).select("id", "label", "vec")
    anchors = materialize(anchors.withColumn("no", F.monotonically_increasing_id()), "anchors")
    n, parts = kept.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // BLOCK), min(parts, -(-n // CHUNK)))

    first = Window.partitionBy("no").orderBy(F.col("score").desc(), "id")
    near = _scan(kept, anchors, blocks, lambda block, chunk: _positives(block, chunk, n_positives))
    near = near.select("no", "id", "score").withColumn("place", F.row_number().over(first)).where(F.col("place") <= n_positives)
    # at most n_positives of each anchor
    of = near.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("place", "score", "id"))).alias("positives"))
    asked = materialize(anchors.join(of, "no"), "asked")
    found = _scan(kept, asked, blocks, lambda block, chunk: _negatives(block, chunk, n_negatives, share))
    each = Window.partitionBy("no", "place").orderBy(F.col("score").desc(), "id")
    found = found.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= n_negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def quantised(column: str | Column, scale: int = 256) -> Column:
    """A vector's components times ``scale``, rounded down; null if one is null or not finite."""
    v = F.col(column) if isinstance(column, str) else column
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, F.transform(v, lambda x: F.floor(x.cast("double") * scale)))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, labels of every seventh moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), quantised("embedding").alias("vec"))
    return mine(rows, F.col("id") % 100 == 0)


ORACLE_SQL = """with good as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
    from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
    from good a join good b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (select * from scored where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select p.anchor_id, p.other as positive_id, (row_number() over (partition by p.anchor_id, p.other order by n.score desc, n.other))::int as rank, n.other as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scored n on n.anchor_id = p.anchor_id and not n.same and 80 * p.score <= 100 * n.score and n.score <= p.score
qualify rank <= 5"""
