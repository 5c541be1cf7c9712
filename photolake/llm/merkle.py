"""A Merkle manifest of a dataset: hash trees over rows in order, proofs of rows, and their check.

Rows are dealt by ranges of (series, id), so every part holds consecutive leaves of a series, whose
place is known from the counts of the parts before it. Each part folds its leaves with a stack for
every level, a mountain range: as soon as a run of :data:`FANOUT` nodes is complete, its digest is
carried to the level above. Runs that reach over the edge of a part are left to a merge of the few
nodes at the edges, level by level, as a grouped aggregate. The last run of a level is hashed as it is,
however short. The subroots of the series are the leaves of one more tree of the same kind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from photolake.llm.tables import table
from photolake.storage import materialize

#: Nodes of a run; a power of two.
FANOUT = 8
#: Leaves of a part, which one task holds in memory when it makes proofs.
PART = 1 << 16
SHIFT = FANOUT.bit_length() - 1
#: Rows handed back at once.
OUT = 4096

HEAD, BORDER, LEAF = 0, 1, 2
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


class Manifest(NamedTuple):
    """What :func:`manifest` writes; digests are lowercase hex.

    ``leaves``: ``series, id, leaf, shown, range``; ``parts``: ``range, series, a, b, total``, the
    places that each of the ``ranges`` holds; ``nodes``: ``series, level, index, size, digest, edge``, all digests
    above the leaves, and the leaves at edges; ``roots``: ``series, subroot``.
    """

    leaves: DataFrame
    parts: DataFrame
    nodes: DataFrame
    roots: DataFrame
    ranges: int


def row_digest(*columns: Column) -> Column:
    """SHA-256 of the columns as text, each preceded by its number of bytes and a colon; ``-`` for null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _hash(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def _sizes(total: int) -> list[int]:
    """The number of nodes of each level, from the leaves to the root."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // FANOUT))
    return out


def _spans(a: int, b: int, sizes: list[int]) -> list[tuple[int, int]]:
    """For each level the nodes that a part with the leaves from ``a`` to before ``b`` makes alone."""
    out = [(a, b)]
    for below, size in zip(sizes, sizes[1:]):
        a, b = -(-a // FANOUT), size if b == below else b // FANOUT
        out.append((a, max(a, b)))
    return out


class _Mountains:
    """Folds one part's leaves; ``rows`` are nodes ``level, index, size, digest, edge``."""

    def __init__(self, a: int, b: int, total: int) -> None:
        self.sizes = _sizes(total)
        self.spans = _spans(a, b, self.sizes)
        self.next = [x for x, _ in self.spans]
        self.open: list[list[str]] = [[] for _ in self.sizes]
        self.rows: list[tuple] = []

    def push(self, digest: str) -> None:
        for level, size in enumerate(self.sizes):
            index = self.next[level]
            self.next[level] += 1
            first = index // FANOUT * FANOUT
            last = min(first + FANOUT, size)
            edge = size > 1 and not (self.spans[level][0] <= first and last <= self.spans[level][1])
            if level or edge or size == 1:
                self.rows.append((level, index, size, digest, edge))
            if edge or size == 1:
                return
            self.open[level].append(digest)
            if index + 1 < last:
                return
            digest = _hash("".join(self.open[level]))
            self.open[level].clear()


def _dealt(leaves: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``leaves`` by ranges of ``series, id``, what places each range holds of each series, and how many ranges there are."""
    spark = leaves.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // PART))
    dealt = materialize(leaves.repartitionByRange(parts, "series", "id", "leaf").withColumn("range", F.spark_partition_id()), "leaves")
    # a row for each range and series
    counts = materialize(dealt.groupBy("range", "series").agg(F.count("*").alias("n")), "counts")
    of = Window.partitionBy("series")
    after = F.sum("n").over(of.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    return dealt, counts.select("range", "series", (after - F.col("n")).alias("a"), after.alias("b"), F.sum("n").over(of).alias("total")), parts


def _stream(m: Manifest, heads: DataFrame, borders: DataFrame | None = None) -> DataFrame:
    """Parts one after the other: a row that tells the places, nodes of others that it needs, its leaves in order."""
    empty = lambda name, kind: F.lit(None).cast(kind).alias(name)
    kind = m.leaves.schema["id"].dataType
    rows = m.leaves.select("range", "series", F.lit(LEAF).alias("kind"), "id", "leaf", "shown", *(empty(x, "long") for x in ("a", "b", "total")), empty("note", "string"))
    note = F.col("note") if "note" in heads.columns else empty("note", "string")
    rows = rows.unionAll(heads.select("range", "series", F.lit(HEAD), empty("id", kind), empty("leaf", "string"), empty("shown", "string"), "a", "b", "total", note))
    if borders is not None:
        rows = rows.unionAll(borders.select("range", "series", F.lit(BORDER), empty("id", kind), F.col("digest"), empty("shown", "string"), F.col("level").cast("long"), "index", empty("total", "long"), empty("note", "string")))
    return rows.repartition(m.ranges, "range").sortWithinPartitions("range", "series", "kind", "id", "leaf")


def _fold(m: Manifest) -> DataFrame:
    """The nodes that parts make alone, and the leaves at their edges."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mountains, series = None, None

        def told() -> pa.RecordBatch:
            rows, mountains.rows = mountains.rows, []
            names = [series] * len(rows)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_())))], ["series", "level", "index", "size", "digest", "edge"])

        for batch in batches:
            kinds, leaf = batch.column("kind").to_pylist(), batch.column("leaf").to_pylist()
            for i, kind in enumerate(kinds):
                if kind == HEAD:
                    if mountains and mountains.rows:
                        yield told()
                    row = batch.slice(i, 1).to_pylist()[0]
                    mountains, series = _Mountains(row["a"], row["b"], row["total"]), row["series"]
                else:
                    mountains.push(leaf[i])
            if mountains and mountains.rows:
                yield told()

    return _stream(m, m.parts).mapInArrow(fold, "series string, level int, index long, size long, digest string, edge boolean")


def manifest(leaves: DataFrame) -> Manifest:
    """Trees over ``series, id, leaf, shown``, one for each series, rows in the order of ``id``.

    ``leaf`` and ``shown`` are digests of rows, ``shown`` of those that are to be checked against the
    tree. Null ids come first, rows that share an id stand by their digests, a null series is a series
    of its own; an empty table has no nodes. A part keeps one run for each level while it folds. Nodes
    at edges are fewer than two runs for each part and level, however long a series is; they are merged
    by runs, level after level, as many levels as the longest series has.
    """
    leaves, parts, ranges = _dealt(materialize(leaves.select("series", "id", "leaf", "shown"), "rows"))
    parts = materialize(parts, "parts")
    made = [materialize(_fold(Manifest(leaves, parts, parts, parts, ranges)), "nodes")]
    longest = parts.agg(F.max("total")).first()[0] or 0
    above = None
    for level in range(len(_sizes(longest)) - 1):
        here = made[0].where("edge").where(F.col("level") == level).drop("edge")
        if above is not None:
            here = here.unionByName(above.where("size > 1"))
        run = F.shiftright("index", SHIFT)
        # a run has FANOUT nodes at most
        nodes = F.array_sort(F.collect_list(F.struct("index", "digest")))
        above = here.groupBy("series", run.alias("run"), "size").agg(F.sha2(F.array_join(F.transform(nodes, lambda x: x["digest"]), ""), 256).alias("digest"))
        above = above.select("series", F.lit(level + 1).alias("level"), F.col("run").alias("index"), F.ceil(F.col("size") / FANOUT).alias("size"), "digest")
        above = materialize(above, "above")
        made.append(above.withColumn("edge", F.col("size") > 1))
    nodes = made[0]
    for more in made[1:]:
        nodes = nodes.unionByName(more)
    return Manifest(leaves, parts, nodes, nodes.where("size = 1").select("series", F.col("digest").alias("subroot")), ranges)


def _needed(m: Manifest) -> DataFrame:
    """``range, series, level, index, digest``: nodes of other parts beside the paths of a part's leaves."""
    levels = m.parts.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(63 // SHIFT)))).withColumn("bits", F.col("level") * SHIFT)
    levels = levels.withColumn("size", F.expr("shiftright(total - 1, bits) + 1")).where("size > 1")
    # what the part makes alone, and the runs that its leaves' paths go through
    levels = levels.withColumn("mine", F.expr("shiftright(a - 1, bits) + 1")).withColumn("ends", F.expr("if(b = total, size, shiftright(b, bits))"))
    whole = lambda name: F.shiftleft(F.shiftright(F.expr(f"shiftright({name}, bits)"), SHIFT), SHIFT)
    levels = levels.withColumn("low", whole("a")).withColumn("high", F.least(whole("b - 1") + FANOUT, F.col("size")))
    steps = F.sequence(F.lit(0), F.lit(FANOUT - 1))
    before = F.filter(F.transform(steps, lambda k: F.col("low") + k), lambda i: i < F.col("mine"))
    behind = F.filter(F.transform(steps, lambda k: F.col("high") - 1 - k), lambda i: (i >= F.col("ends")) & (i >= F.col("low")))
    wanted = levels.select("range", F.col("series").alias("of"), F.col("level").alias("at"), F.explode(F.array_distinct(F.concat(before, behind))).alias("place"))
    met = wanted.join(m.nodes.where("edge"), F.col("series").eqNullSafe(F.col("of")) & (F.col("level") == F.col("at")) & (F.col("index") == F.col("place")))
    return met.select("range", "series", "level", "index", "digest")


def _path(index: int, levels: list, spans: list, sizes: list, border: dict) -> list[tuple[str, str]]:
    """The siblings before and behind a node's ancestors, from the level above the leaves."""
    out = []
    for level in range(1, len(sizes) - 1):
        index //= FANOUT
        first = index // FANOUT * FANOUT
        a, b = spans[level]
        run = [levels[level][i - a] if a <= i < b else border[level, i] for i in range(first, min(first + FANOUT, sizes[level]))]
        out.append(("".join(run[: index - first]), "".join(run[index - first + 1 :])))
    return out


def _folded(digest: str, path: list[tuple[str, str]]) -> str:
    for before, behind in path:
        digest = _hash(before + digest + behind)
    return digest


def proofs(m: Manifest, above: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """``series, id, leaf, proof, proof_sha256, folded, tag`` of every leaf.

    ``proof`` lists the siblings of the leaf and of its ancestors, a line for each level: those before,
    a colon, those behind; it is left null unless ``whole``. ``above`` (``series, tag, proof``) has more
    such lines, of a tree above, for each series, and a word that its leaves are marked with.
    ``proof_sha256`` is the digest of all siblings in order, ``folded`` what comes out at the top when
    ``shown`` takes the leaf's place. A task holds the leaves of one part.
    """
    heads = m.parts.withColumn("note", F.lit("\n"))
    if above is not None:
        of = above.select(F.col("series").alias("of"), F.concat_ws("\n", "tag", "proof").alias("note"))
        heads = m.parts.join(of, F.col("series").eqNullSafe(F.col("of"))).drop("of")
    names = ["series", "id", "leaf", "proof", "proof_sha256", "folded", "tag"]

    def proved(head: dict, border: dict, ids: pa.Array, leaf: list[str], shown: list[str]) -> Iterator[pa.RecordBatch]:
        a, b, (tag, *lines) = head["a"], head["b"], head["note"].split("\n")
        top = [tuple(x.split(":")) for x in lines if x]
        sizes = _sizes(head["total"])
        spans = _spans(a, b, sizes)
        levels = [leaf]
        for (first, _), (start, end), size in zip(spans, spans[1:], sizes):
            below = levels[-1]
            levels.append([_hash("".join(below[FANOUT * i - first : min(FANOUT * i + FANOUT, size) - first])) for i in range(start, end)])
        run, first, upper, out = [], -1, top, []
        behind = "".join(x + y for x, y in top)
        for k, digest in enumerate(leaf):
            path = upper
            if sizes[0] > 1:
                if (a + k) // FANOUT * FANOUT != first:
                    first = (a + k) // FANOUT * FANOUT
                    run = [leaf[i - a] if a <= i < b else border[0, i] for i in range(first, min(first + FANOUT, sizes[0]))]
                    upper = _path(a + k, levels, spans, sizes, border) + top
                    behind = "".join(x + y for x, y in upper)
                at = a + k - first
                path = [("".join(run[:at]), "".join(run[at + 1 :])), *upper]
            siblings = path[0][0] + path[0][1] + behind if sizes[0] > 1 else behind
            out.append((digest, "\n".join(f"{x}:{y}" for x, y in path) if whole else None, _hash(siblings), _folded(shown[k], path)))
            if len(out) == OUT or k + 1 == len(leaf):
                n = len(out)
                yield pa.RecordBatch.from_arrays([pa.array([head["series"]] * n, pa.string()), ids.slice(k + 1 - n, n), *(pa.array([r[i] for r in out], pa.string()) for i in range(4)), pa.array([tag] * n, pa.string())], names)
                out = []

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, border, ids, leaf, shown = None, {}, [], [], []
        for batch in batches:
            kinds = np.array(batch.column("kind").to_pylist())
            cuts = [0, *(np.flatnonzero(np.diff(kinds == LEAF)) + 1).tolist(), len(kinds)]
            for start, end in zip(cuts, cuts[1:]):
                some = batch.slice(start, end - start)
                if start < end and kinds[start] == LEAF:
                    ids.append(some.column("id"))
                    leaf += some.column("leaf").to_pylist()
                    shown += some.column("shown").to_pylist()
                    continue
                for row in some.to_pylist():
                    if row["kind"] == BORDER:
                        border[row["a"], row["b"]] = row["leaf"]
                        continue
                    if leaf:
                        yield from proved(head, border, pa.concat_arrays(ids), leaf, shown)
                    head, border, ids, leaf, shown = row, {}, [], [], []
        if leaf:
            yield from proved(head, border, pa.concat_arrays(ids), leaf, shown)

    kind = m.leaves.schema["id"].dataType
    schema = T.StructType([T.StructField(x, kind if x == "id" else T.StringType()) for x in names])
    return _stream(m, heads, _needed(m)).mapInArrow(prove, schema)


def verified(docs: DataFrame, changed: dict[str, Column] | None = None, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", series_col: str = "lang", whole: bool = True) -> DataFrame:
    """``id, series, leaf, subroot, root, proof, proof_sha256, folded_root, verified`` of every row.

    The manifest is made from ``docs`` as they are; each row is then checked by its proof as it is with
    the columns of ``changed`` put in their places. Nulls in any column have their place in the digest
    of a row; a null series comes before the others. Rows that share an id stand by their digests;
    repeated rows are leaves of their own; texts of any length are hashed whole, by built-in functions;
    other columns are not read, whatever their names. An empty table gives no rows.
    """
    now = {c: F.col(c) for c in columns}
    rows = docs.select(F.col(series_col).cast("string").alias("series"), F.col(id_col).alias("id"), row_digest(*now.values()).alias("leaf"), row_digest(*(now | (changed or {})).values()).alias("shown"))
    below = manifest(rows)
    # a row for each series
    roots = materialize(below.roots.select(F.lit("").alias("series"), F.col("series").alias("id"), F.col("subroot").alias("leaf"), F.col("subroot").alias("shown")), "roots")
    tops = proofs(manifest(roots)).select(F.col("id").alias("series"), F.concat_ws(" ", "leaf", "folded").alias("tag"), "proof")
    found = proofs(below, materialize(tops, "tops"), whole)
    ends = F.split("tag", " ")
    return found.select("id", "series", "leaf", ends[0].alias("subroot"), ends[1].alias("root"), "proof", "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == ends[1]).alias("verified"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, and whether a third of them, with A-Z lowered, is found out."""
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = {"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lowered).otherwise(F.col("text"))}
    found = verified(docs, changed, whole=False)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _field(x: str) -> str:
    return f"coalesce(strlen({x}::varchar)::varchar || ':' || {x}::varchar, '-')"


def _tree(name: str, placed: str, series: str, leaf: str) -> str:
    """``series, level, run, nodes``: the runs of each level as lists, one level after the other."""
    return f"""{name} as (
    select {series} as series, 0 as level, i // 8 as run, list({leaf} order by i) as nodes from {placed} group by 1, 3
    union all
    select series, level + 1, run // 8, list(sha256(array_to_string(nodes, '')) order by run) from (select *, count(*) over (partition by series) as runs from {name}) where runs > 1 group by 1, 2, 3)"""


def _climb(name: str, start: str, tree: str) -> str:
    """``start`` (``doc_id, series, i, digest, siblings``) level by level to the top of ``tree``."""
    return f"""{name} as (
    select doc_id, series, 0 as level, i, digest, siblings from {start}
    union all
    select doc_id, c.series, c.level + 1, i // 8, sha256(array_to_string(nodes[:i % 8], '') || digest || array_to_string(nodes[i % 8 + 2:], '')), siblings || array_to_string(nodes[:i % 8], '') || array_to_string(nodes[i % 8 + 2:], '')
    from {name} c join {tree} t on t.series is not distinct from c.series and t.level = c.level and t.run = i // 8 where len(nodes) > 1 or t.level > 0 or i > 7)"""


_TOP = "arg_max(case when level = 0 and len(nodes) = 1 then nodes[1] else sha256(array_to_string(nodes, '')) end, level)"

#: CRC-32 of the decimal id, bit by bit; runs are lists, and a proof is what stands around a path.
ORACLE_SQL = f"""with recursive marked as (
    select *, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
        lambda x, b: list_reduce([xor(x, b)] || range(8), lambda y, k: case when y & 1 = 1 then xor(y >> 1, 3988292384) else y >> 1 end))) % 3 = 0 as hit from documents),
texts as (select *, case when hit then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as other from marked),
hashed as (select doc_id, lang, sha256({" || ".join(map(_field, COLUMNS))}) as leaf, sha256({" || ".join(map(_field, (*COLUMNS[:-1], "other")))}) as shown from texts),
placed as (select *, row_number() over (partition by lang order by doc_id) - 1 as i from hashed),
{_tree("runs_", "placed", "lang", "leaf")},
subroots as (select series as lang, {_TOP} as subroot from runs_ group by 1),
tops as (select *, row_number() over (order by lang nulls first) - 1 as i from subroots),
{_tree("top_runs", "tops", "1", "subroot")},
root as (select {_TOP} as root from top_runs),
leaves as (select doc_id, lang as series, i, shown as digest, '' as siblings from placed),
{_climb("inner_", "leaves", "runs_")},
halfway as (select doc_id, 1 as series, any_value(t.i) as i, arg_max(digest, level) as digest, arg_max(siblings, level) as siblings from inner_ c join tops t on t.lang is not distinct from c.series group by 1),
{_climb("outer_", "halfway", "top_runs")},
folded as (select doc_id, arg_max(digest, level) as folded_root, sha256(arg_max(siblings, level)) as proof_sha256 from outer_ group by 1)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified
from placed join folded using (doc_id) join subroots s on s.lang is not distinct from placed.lang cross join root"""
