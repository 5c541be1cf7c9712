"""Embedding near-duplicates by NN-descent on Spark.

A neighbour graph is started from chunks of randomly projected orders and refined through joins of
neighbours of neighbours. A list that is saturated with links grows. The links are those of the graph,
whose recall is measured against brute force. Only lists that reach the longest length there is are
left for the exact way: what such vectors link with is counted block against block in their group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from photolake.llm.tables import table
from photolake.operators.components import connected_components
from photolake.storage import materialize

#: Least sign bits of a projected order's key; the next projection orders vectors of one key.
SIGNS = 10
#: Chance that two linked vectors of one key fall into one chunk, when about a chunk of vectors shares a key.
SAME_CHUNK = 0.75
#: Chance with which a lone pair is to meet in one of the orders, and the most orders that are made for it.
MEETS, MOST_ORDERS = 0.99, 128
#: Vectors of a group that are compared as one block.
BLOCK = 256
#: Blocks whose representatives are compared at once.
TILE = 1024


def _unit(data: list[bytes], kind: str) -> np.ndarray:
    """Vectors from their bytes, in double precision, of length 1."""
    v = np.frombuffer(b"".join(data), kind).astype(np.float64).reshape(len(data), -1)
    # very large and very small components would be lost when they are squared
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1))[:, None]


def usable(column: str):
    """Whether a vector has a direction: not null, no null or non-finite component, and not zero."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(x.isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` of what can be linked; rows that share an id are one vector, the smallest of them."""
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where(F.col("vec_id").isNotNull() & usable("vector"))
    v = v.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return materialize(v, "vectors")


def _packed(kind: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.array(x, kind).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in out], pa.int32()), pa.array(out, pa.binary())], ["cid", "size", "vec"])

    return pack


def _best(lists: DataFrame, k: int, k_most: int, threshold: float) -> DataFrame:
    """Each vector's ``k`` nearest neighbours, and all its links while they are at most ``k_most``.

    So a list that is saturated with links is enlarged in the round in which it fills up.
    """
    order = Window.partitionBy("src").orderBy(F.col("sim").desc(), "dst")
    ranked = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k_most)
    return ranked.where((F.col("rank") <= k) | (F.col("sim") >= threshold)).select("src", "dst", "sim", "fresh")


def _pair_rows(ids: np.ndarray, sims: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
    i, j = np.nonzero(keep)
    return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(sims[i, j])], ["src", "dst", "sim"])


def spread_of_orders(n: int, threshold: float, leaf: int) -> tuple[int, int]:
    """Signs of a key and orders by which two of ``n`` vectors at ``threshold`` meet with the chance ``MEETS``.

    Keys are as many as chunks, so that about a chunk of vectors shares one at any ``n``. A sign is
    the same for both with a chance that their angle gives.
    """
    signs = min(30, max(SIGNS, int(np.ceil(np.log2(max(1, n) / leaf)))))
    met = SAME_CHUNK * (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** signs
    return signs, int(min(MOST_ORDERS, np.ceil(np.log(1 - MEETS) / np.log1p(-max(met, 1e-9)))))


def _started(packed: DataFrame, kind: str, orders: int, signs: int, leaf: int, k: int, parts: int, seed: int) -> DataFrame:
    """Nearest neighbours within chunks of ``leaf`` vectors of ``orders`` random orders.

    An order sorts by the signs of ``signs`` random projections and then by one more projection, so a
    chunk holds vectors of similar direction and is never larger, however many are alike.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict = {}
        for batch in batches:
            for size in set(batch.column(1).to_pylist()):
                some = batch.filter(pa.array([x == size for x in batch.column(1).to_pylist()]))
                v = _unit(some.column(2).to_pylist(), kind)
                if v.shape[1] not in planes:
                    planes[v.shape[1]] = np.random.default_rng(seed).normal(size=(orders, signs + 1, v.shape[1]))
                for o in range(orders):
                    p = v @ planes[v.shape[1]][o].T
                    code = ((p[:, :signs] > 0) << np.arange(signs)).sum(1)
                    # Gray order: neighbouring codes differ in one sign
                    for shift in (1, 2, 4, 8, 16):
                        code = code ^ (code >> shift)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), o, np.int32)), some.column(1), pa.array(code.astype(np.int32)), pa.array(p[:, signs]), some.column(0), some.column(2)], ["ord", "size", "code", "fine", "cid", "vec"])

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list = []

        def near(rows: list) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(rows), leaf):
                some = rows[a : a + leaf]
                if len(some) < 2:
                    continue
                v = _unit([r[2] for r in some], kind)
                s = v @ v.T
                np.fill_diagonal(s, -2)
                top = min(k, len(some) - 1)
                kth = np.partition(s, -top, axis=1)[:, -top]
                yield _pair_rows(np.array([r[3] for r in some]), s, s >= np.maximum(kth[:, None], -1.5))

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if left and (left[0][0] != row[0] or left[0][1] != row[1]):
                    yield from near(left)
                    left = []
                left.append(row)
                if len(left) == leaf * 64:
                    yield from near(left)
                    left = []
        yield from near(left)

    kind_of = packed.schema["cid"].dataType
    keyed = packed.mapInArrow(keys, T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("code", T.IntegerType()), T.StructField("fine", T.DoubleType()), T.StructField("cid", kind_of), T.StructField("vec", T.BinaryType())]))
    dealt = keyed.repartitionByRange(parts, "ord", "size", "code", "fine").sortWithinPartitions("ord", "size", "code", "fine", "cid")
    found = dealt.select("ord", "size", "vec", "cid").mapInArrow(chunk, _pairs_type(kind_of))
    return found.groupBy("src", "dst").agg(F.max("sim").alias("sim")).withColumn("fresh", F.lit(True))


def _pairs_type(kind) -> T.StructType:
    return T.StructType([T.StructField("src", kind), T.StructField("dst", kind), T.StructField("sim", T.DoubleType())])


def _refined(graph: DataFrame, packed: DataFrame, kind: str, k: int, k_most: int, threshold: float, drawn: int, turn: int, parts: int) -> DataFrame:
    """New neighbours: vectors that meet in a third one's list, or name it in theirs.

    Of each vector's list, and of the lists that name it, ``drawn`` members are brought together with
    their vectors, by a hash that differs from round to round, so that long lists are gone through in
    turns. They are compared, and a pair goes out when it improves one
    of its two lists: any link improves a list that is saturated and shorter than ``k_most``. Pairs
    without a fresh member are compared by vectors with saturated lists alone.
    """
    per = graph.groupBy(F.col("src").alias("cid")).agg(F.min("sim").alias("least"), F.count("*").alias("n"), F.count_if(F.col("sim") >= threshold).alias("links"))
    nodes = packed.join(per, "cid", "left").withColumn("dense", F.coalesce(F.col("links") >= k, F.lit(False)))
    worst = F.when(F.col("links") >= k_most, 2.0).when(F.col("dense"), float(np.nextafter(threshold, -1))).when(F.col("n") >= k, F.col("least")).otherwise(-2.0)
    nodes = nodes.select("cid", "size", "vec", worst.alias("worst"), "dense")
    both = graph.select("src", "dst", "fresh", F.lit(0).alias("side")).unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "fresh", F.lit(1).alias("side")))
    order = Window.partitionBy("src", "side").orderBy(F.xxhash64("src", "dst", F.lit(turn)), "dst")
    some = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= drawn)
    around = some.groupBy("src", "dst").agg(F.max("fresh").alias("fresh"))
    met = around.join(nodes, F.col("dst") == F.col("cid")).select("src", "dst", "size", "fresh", "worst", "vec")
    met = met.join(nodes.select(F.col("cid").alias("src"), "dense"), "src").select("src", "dst", "size", (F.col("fresh") | F.col("dense")).alias("fresh"), "worst", "vec")
    met = met.repartition(parts, "src").sortWithinPartitions("src", "dst")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 1):
            size = rows[0][2]
            rows = [r for r in rows if r[2] == size]
            if len(rows) < 2 or not any(r[3] for r in rows):
                continue
            s = (v := _unit([r[5] for r in rows], kind)) @ v.T
            fresh, worst = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
            better = (fresh[:, None] | fresh) & ((s > worst[:, None]) | (s > worst))
            np.fill_diagonal(better, False)
            if better.any():
                yield _pair_rows(np.array([r[1] for r in rows]), s, better)

    found = met.mapInArrow(compare, _pairs_type(packed.schema["cid"].dataType)).withColumn("fresh", F.lit(True))
    # a neighbour that was there before is not fresh
    every = graph.withColumn("fresh", F.lit(False)).unionByName(found).groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    return _best(every, k, k_most, threshold)


def neighbour_graph(packed: DataFrame, kind: str, threshold: float, k: int, k_most: int, drawn: int, orders: int, signs: int, leaf: int, rounds: int, settled: float, parts: int, seed: int) -> DataFrame:
    """``src, dst, sim``: refined until a round changes less than ``settled`` of the neighbours.

    Then long lists are drawn twice as far, for the few links that they still lack, until a
    round changes less than a hundredth of that.
    """
    graph = materialize(_best(_started(packed, kind, orders, signs, leaf, k, parts, seed), k, k_most, threshold), "graph")
    last = False
    for turn in range(rounds):
        graph = materialize(_refined(graph, packed, kind, k, k_most, threshold, 2 * drawn if last else drawn, turn, parts), "graph")
        n, fresh = graph.agg(F.count("*"), F.count_if("fresh")).first()
        if last and fresh <= settled / 100 * n:
            break
        last = last or fresh <= settled * n
    return graph


def _placed(members: DataFrame) -> DataFrame:
    """``members`` with the ``block`` of its component that each stands in, and its number of ``blocks``.

    Places are counted in two steps, so that no task ranks all members of a large group.
    """
    dealt = members.withColumn("deal", F.pmod(F.xxhash64("cid"), F.lit(1024)))
    counts = dealt.groupBy("component", "deal").agg(F.count("*").alias("c"))
    base = counts.select("component", "deal", F.coalesce(F.sum("c").over(Window.partitionBy("component").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("c").over(Window.partitionBy("component")).alias("all"))
    placed = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("component", "deal").orderBy("cid")) - 1).join(base, ["component", "deal"])
    return placed.select(*members.columns, F.floor((F.col("base") + F.col("rank")) / BLOCK).cast("int").alias("block"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list]:
    """Rows that follow each other and agree in their first ``keys`` columns."""
    left: list = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if left and left[0][:keys] != row[:keys]:
                yield left
                left = []
            left.append(row)
    if left:
        yield left


def _bridges(groups: DataFrame, packed: DataFrame, kind: str, threshold: float, parts: int) -> DataFrame:
    """``src, dst``: links that join whatever different components of ``groups`` have a link between their members.

    Exact. Each block of a component is stood for by a member and its largest angle to the others.
    All representatives of different components are compared, tile by tile; two that link are a link,
    and blocks within the angle of ``threshold`` and their own two angles are compared in full. Only
    links that join something within their tile go out, and one for each pair of blocks.
    """
    members = groups.join(packed, F.col("node") == F.col("cid")).select("component", "cid", "size", "vec")
    placed = materialize(_placed(members).select("component", "block", "cid", "size", "vec"), "placed")
    kind_of = packed.schema["cid"].dataType
    widest = float(np.arccos(np.clip(threshold, -1, 1)))

    def stand_for(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 2):
            v = _unit([r[4] for r in rows], kind)
            angles = np.arccos(np.clip(v @ v[0], -1, 1))
            yield pa.RecordBatch.from_pylist([dict(zip(pieces_type.names, (*rows[0], float(angles.max()))))], schema=to_arrow_schema(pieces_type))

    from pyspark.sql.pandas.types import to_arrow_schema

    pieces_type = T.StructType([T.StructField("component", kind_of), T.StructField("block", T.IntegerType()), T.StructField("cid", kind_of), T.StructField("size", T.IntegerType()), T.StructField("vec", T.BinaryType()), T.StructField("radius", T.DoubleType())])
    pieces = materialize(placed.repartition(parts, "component", "block").sortWithinPartitions("component", "block", "cid").mapInArrow(stand_for, pieces_type), "pieces")
    tiles = max(1, -(-pieces.count() // TILE))
    tiled = pieces.withColumn("tile", F.pmod(F.xxhash64("component", "block"), F.lit(tiles)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    spread = tiled.select(F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "tile", *pieces_type.names)
    spread = spread.repartition(parts, "one", "two").sortWithinPartitions("one", "two", "tile", "component", "block")
    met_type = T.StructType([T.StructField("src", kind_of), T.StructField("dst", kind_of), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 2):
            one, two = rows[0][:2]
            root: dict = {}

            def top(c):
                while (up := root.get(c, c)) != c:
                    root[c] = c = root.get(up, up)
                return c

            out: list = []
            for size in {r[6] for r in rows}:
                a = [r for r in rows if r[2] == one and r[6] == size]
                b = a if one == two else [r for r in rows if r[2] == two and r[6] == size]
                if not a or not b:
                    continue
                va = _unit([r[7] for r in a], kind)
                s = va @ (va if one == two else _unit([r[7] for r in b], kind)).T
                ahead = np.triu(np.ones(s.shape, bool), 1) if one == two else np.ones(s.shape, bool)
                linked = s >= threshold
                for i, j in np.argwhere(linked & ahead).tolist():
                    if (x := top(a[i][3])) != (y := top(b[j][3])):
                        root[x] = y
                        out.append((a[i][5], b[j][5], None, None))
                reach = widest + np.array([r[8] for r in a])[:, None] + np.array([r[8] for r in b]) + 1e-6
                for i, j in np.argwhere((np.arccos(np.clip(s, -1, 1)) <= reach) & ~linked & ahead).tolist():
                    if top(a[i][3]) != top(b[j][3]):
                        out.append((a[i][3], b[j][3], a[i][4], b[j][4]))
            yield pa.RecordBatch.from_pylist([dict(zip(met_type.names, r)) for r in out], schema=to_arrow_schema(met_type))

    met = materialize(spread.mapInArrow(meet, met_type), "met")
    near = met.where("a is not null")
    ours, theirs = near.withColumn("side", F.lit(0)), near.withColumn("side", F.lit(1))
    ours = ours.join(placed, (F.col("src") == F.col("component")) & (F.col("a") == F.col("block")))
    theirs = theirs.join(placed, (F.col("dst") == F.col("component")) & (F.col("b") == F.col("block")))
    both = ours.unionByName(theirs).select("src", "dst", "a", "b", "side", "cid", "vec")
    both = both.repartition(parts, "src", "dst", "a", "b").sortWithinPartitions("src", "dst", "a", "b", "side")
    link_type = T.StructType([T.StructField("src", kind_of), T.StructField("dst", kind_of)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 4):
            a, b = ([r for r in rows if r[4] == side] for side in (0, 1))
            linked = _unit([r[6] for r in a], kind) @ _unit([r[6] for r in b], kind).T >= threshold
            if linked.any():
                i, j = np.argwhere(linked)[0].tolist()
                yield pa.RecordBatch.from_pylist([{"src": a[i][5], "dst": b[j][5]}], schema=to_arrow_schema(link_type))

    return met.where("a is null").select("src", "dst").unionByName(both.mapInArrow(compare, link_type))


def _joined(groups: DataFrame, some: DataFrame, packed: DataFrame, kind: str, threshold: float, parts: int) -> DataFrame:
    """``groups`` with the components joined that have a link between members in ``some`` of their rows."""
    bridges = materialize(_bridges(some, packed, kind, threshold, parts), "bridges")
    if bridges.isEmpty():
        return groups
    held = groups.select(F.col("node").alias("src"), F.col("component").alias("dst"))
    return materialize(connected_components(held.unionByName(bridges), "src", "dst"), "groups")


def _counted(groups: DataFrame, full: DataFrame, packed: DataFrame, sizes: DataFrame, kind: str, threshold: float, parts: int) -> DataFrame:
    """``cid, links, near``: how many vectors, and different ones, each of ``full`` links with, exactly.

    The groups of such vectors are cut into blocks of ``BLOCK`` members, and each pair of blocks is
    compared by one task; only sums leave it. Pairs of vectors are never emitted.
    """
    marked = groups.join(full.select(F.col("cid").alias("node"), F.lit(True).alias("full")), "node", "left")
    concerned = marked.where("full").select("component").distinct()
    members = marked.join(concerned, "component", "left_semi").join(packed, F.col("node") == F.col("cid")).join(sizes, "cid")
    placed = _placed(members.select("component", "cid", "n", "vec", F.coalesce("full", F.lit(False)).alias("full")))
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = placed.withColumn("other", meets).select("component", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "cid", "n", "vec", "full")
    spread = spread.repartition(parts, "component", "one", "two").sortWithinPartitions("component", "one", "two", "block")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 3):
            one, two = rows[0][1], rows[0][2]
            a = [r for r in rows if r[3] == one]
            b = a if one == two else [r for r in rows if r[3] == two]
            if not a or not b:
                continue
            va = _unit([r[6] for r in a], kind)
            vb = va if one == two else _unit([r[6] for r in b], kind)
            near = va @ vb.T >= threshold
            if one == two:
                np.fill_diagonal(near, False)
            na, nb = np.array([r[5] for r in a], np.int64), np.array([r[5] for r in b], np.int64)
            for side, sums, different in ((a, near @ nb, near.sum(1)), (b, near.T @ na, near.sum(0)))[: 1 if one == two else 2]:
                keep = np.array([r[7] for r in side])
                yield pa.RecordBatch.from_arrays([pa.array([r[4] for r in side if r[7]], ids), pa.array(sums[keep], pa.int64()), pa.array(different[keep], pa.int64())], ["cid", "links", "near"])

    from pyspark.sql.pandas.types import to_arrow_type

    ids = to_arrow_type(packed.schema["cid"].dataType)
    schema = T.StructType([packed.schema["cid"], T.StructField("links", T.LongType()), T.StructField("near", T.LongType())])
    return spread.mapInArrow(count, schema).groupBy("cid").agg(F.sum("links").alias("links"), F.sum("near").alias("near"))


def audit(near: DataFrame, asked: DataFrame, packed: DataFrame, kind: str, threshold: float, k: int, queries: int) -> float:
    """The recall of a graph's links: the lesser one of vectors with ``k`` links or more and of others.

    ``near`` has ``cid, near``, how many links the graph gives a vector that has some; ``asked`` are the
    vectors whose lists could hold more. Of these, ``queries`` vectors each of dense, sparse and lone ones, chosen by a
    hash of their id, are compared with all vectors, run by run. Every vector that has links weighs the
    same. Lone vectors that have some are counted as missed, in proportion to how many there are.
    """
    among = F.when(F.col("near") == 0, "lone").when(F.col("near") >= k, "dense").otherwise("sparse")
    every = materialize(asked.select("cid").join(near, "cid", "left").select("cid", F.coalesce("near", F.lit(0)).alias("near")).withColumn("among", among), "audited")
    there = {r["among"]: r["count"] for r in every.groupBy("among").count().collect()}
    picks = None
    for kind_of in sorted(there):
        some = every.where(F.col("among") == kind_of).orderBy(F.xxhash64("cid", F.lit(1)), "cid").limit(queries)
        picks = some if picks is None else picks.unionByName(some)
    if picks is None:
        return 1.0
    picks = materialize(picks, "queries")
    by_size: dict = {}
    for r in packed.join(picks, "cid", "left_semi").collect():
        by_size.setdefault(r["size"], []).append(r)
    sent = {size: ([r["cid"] for r in rows], _unit([bytes(r["vec"]) for r in rows], kind)) for size, rows in by_size.items()}

    def true_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(batch.column(1).to_pylist())
            for size, (ids, q) in sent.items():
                some = batch.filter(pa.array(sizes == size))
                if some.num_rows:
                    v = _unit(some.column(2).to_pylist(), kind)
                    same = np.array(ids)[:, None] == np.array(some.column(0).to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(((q @ v.T >= threshold) & ~same).sum(1))], ["cid", "real"])

    real = packed.mapInArrow(true_links, T.StructType([packed.schema["cid"], T.StructField("real", T.LongType())])).groupBy("cid").agg(F.sum("real").alias("real"))
    share = F.when(F.col("real") > 0, F.least("near", "real") / F.col("real"))
    rated = {r["among"]: r for r in picks.join(real, "cid").groupBy("among").agg(F.avg(share).alias("share"), F.avg((F.col("real") > 0).cast("int")).alias("linked")).collect()}
    linked = {a: there[a] * (r["linked"] if a == "lone" else 1) for a, r in rated.items()}
    had = {a: linked[a] * (r["share"] or 0.0) for a, r in rated.items()}
    few = linked.get("sparse", 0) + linked.get("lone", 0)
    return min(had["dense"] / linked["dense"] if "dense" in had else 1.0, (had.get("sparse", 0) + had.get("lone", 0)) / few if few else 1.0)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, k: int = 8, k_most: int = 512, drawn: int = 24, orders: int = 8, leaf: int = 64, rounds: int = 12, settled: float = 0.01, wanted: float = 0.99, recall: float = 0.9, queries: int = 512, tries: int = 3, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``.

    Two vectors are linked when their cosine, in double precision, is ``threshold`` or more and the
    neighbour graph holds the pair. Equal vectors take part as one and count in full. There are
    ``orders`` orders or more, as the number of vectors asks (:func:`spread_of_orders`). A list has
    ``k`` neighbours and grows while all of them are links. The links of the graph are counted and
    joined to components. Lists of ``k_most`` links are not followed further: links of such vectors
    are counted exactly within their component (:func:`_counted`), and components of such vectors are
    compared exactly for links between them that both lists may have left out (:func:`_bridges`).

    The graph's recall is measured on ``queries`` vectors of each kind (:func:`audit`). While it is
    below ``wanted`` the search runs again with other projections, twice as many orders and lists
    twice as long, at most ``tries`` times in all, and the links of all runs are kept. If it then is
    below ``recall`` that is an error.

    ``component_id`` is the smallest id reachable over links, the row's own included, and ``kept``
    marks the row that bears it. Neighbours of the same cosine are taken by the smaller id, which
    decides no link. Vectors that are null, empty, zero or not finite link with nothing, and so do
    vectors of different lengths. Repeated rows get equal rows; rows that share an id count as one
    vector, the smallest; rows without an id link with nothing and are not kept. Other columns are not
    read, whatever their names. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    element = vectors.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = _usable_vectors(vectors, id_col, vector_col)
    classes = materialize(raw.groupBy("vector").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n")), "classes")
    sizes = classes.select("cid", "n")
    packed_type = T.StructType([classes.schema["cid"], T.StructField("size", T.IntegerType()), T.StructField("vec", T.BinaryType())])
    packed = materialize(classes.select("cid", "vector").repartition(parts, "cid").mapInArrow(_packed(kind), packed_type), "packed")
    signs, needed = spread_of_orders(packed.count(), threshold, leaf)
    orders = max(orders, needed)
    pairs = None
    for i in range(tries):
        graph = neighbour_graph(packed, kind, threshold, k << i, max(k_most, k << i), drawn, orders << i, signs, leaf, rounds, settled, parts, seed + i)
        found = graph.where(F.col("sim") >= threshold).select("src", "dst")
        both = found.unionByName(found.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        pairs = materialize((both if pairs is None else both.unionByName(pairs)).distinct(), "pairs")
        near = materialize(pairs.join(sizes, F.col("dst") == F.col("cid")).groupBy("src").agg(F.count("*").alias("near"), F.sum("n").alias("links")).withColumnRenamed("src", "cid"), "near")
        # lists of the last run that are as long as a list may be
        full = materialize(found.groupBy(F.col("src").alias("cid")).count().where(F.col("count") >= max(k_most, k << i)).select("cid"), "full")
        reached = audit(near, packed.join(full, "cid", "left_anti"), packed, kind, threshold, k, queries)
        if reached >= wanted:
            break
    if reached < recall:
        raise ValueError(f"the graph holds {reached:.3f} of the links, less than {recall}, after {tries} searches")
    groups = materialize(connected_components(pairs, "src", "dst"), "groups")
    links = near.select("cid", "links")
    if not full.isEmpty():
        groups = _joined(groups, groups.join(full, F.col("node") == F.col("cid"), "left_semi"), packed, kind, threshold, parts)
        exact = materialize(_counted(groups, full, packed, sizes, kind, threshold, parts), "exact")
        links = links.join(full, "cid", "left_anti").unionByName(exact.select("cid", "links"))
    least = sizes.join(groups, F.col("cid") == F.col("node"), "left").join(links, "cid", "left")
    least = least.select("cid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    members = raw.join(classes, "vector").select("vec_id", "cid").join(least, "cid").select(F.col("vec_id").alias("id"), "n_links", "component_id")
    rows = vectors.select(F.col(id_col).alias("vec_id"))
    out = rows.join(members, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op1_nn_descent(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates among all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
