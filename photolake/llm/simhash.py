"""SimHash near-duplicates: fingerprints joined through their segments' bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photolake.llm.tables import LOWER, table, unused
from photolake.operators.components import connected_components
from photolake.storage import materialize

SEED = 42
#: Hashes whose bits are counted at once.
RUN = 1 << 16


def fingerprint(text: str | None, words_each: int = 3) -> int:
    """The 64-bit SimHash of a text, as a signed integer.

    A-Z are lowered; words are what ASCII white space parts. Each run of ``words_each`` words, joined
    by spaces, counts as often as it stands; a shorter text is one run, an empty or null one gives 0.
    """
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(n, words_each)
    starts, ends = starts[: n - k + 1].tolist(), ends[k - 1 :].tolist()
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), RUN):
        run = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[i : i + RUN], ends[i : i + RUN])], "<u8")
        counts += np.unpackbits(run.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp`` of every row (64 bits, signed), in one narrow pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fingerprint(x.as_py(), words_each) for x in batch.column(2)], pa.int64())], ["doc_id", "text_hash", "fp"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return picked.mapInArrow(scan, picked.select("doc_id", "text_hash").withColumn("fp", F.lit(0).cast("long")).schema)


def segment_counts(fp: Column, width: int) -> Column:
    """The bit counts of the segments of ``width`` bits (1, 2 or 4) of a fingerprint, ``width`` bits each in one number."""
    counts = fp
    if width >= 2:
        # two bits a and b have (a xor b) + 2 (a and b) of them set; a plain sum would reach the sign
        low = F.lit(0x5555555555555555)
        a, b = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
        counts = a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))
    if width == 4:
        low = F.lit(0x3333333333333333)
        counts = counts.bitwiseAND(low) + F.shiftrightunsigned(counts, 2).bitwiseAND(low)
    return counts


def manhattan(a: Column, b: Column, width: int, first: int, last: int) -> Column:
    """The Manhattan distance of two points made by :func:`segment_counts`, over segments from ``first`` to before ``last``."""
    count = lambda x, i: F.shiftrightunsigned(x, width * i).bitwiseAND(F.lit((1 << width) - 1))
    return sum((F.abs(count(a, i) - count(b, i)) for i in range(first, last)), F.lit(0))


def segment_width(points: int) -> int:
    """Bits of a segment: short ones, whose grid has many cells, for many points."""
    return 4 if points <= 1 << 12 else 2 if points <= 1 << 24 else 1


def fingerprint_links(fps: DataFrame, most: int = 3, width: int | None = None) -> DataFrame:
    """All pairs ``a < b`` of different fingerprints ``fp`` that differ in at most ``most`` bits.

    A fingerprint is a point whose coordinates are the bit counts of its segments; the Manhattan
    distance of two points never exceeds the number of differing bits. The segments fall into
    ``most // 2 + 1`` runs, so of two points within ``most`` one run at least has a distance of 1 or
    0. For each run there is a grid over its coordinates, and partners within 1 stand in one cell or in
    two that are neighbours along one coordinate: each point is in its own cell, and looks into those
    of its neighbours whose count is higher by one. A pair is taken in the first run that brings it
    together, and its differing bits are counted exactly. Nothing is capped; a fingerprint has no more
    partners than there are numbers within ``most`` bits of it (43,744 others for 3), however many
    documents are alike.
    """
    points = materialize(fps.select("fp").distinct(), "points")
    width = width or segment_width(points.count())
    segments, runs = 64 // width, most // 2 + 1
    reach = min(1, most // runs)
    ends = [round(i * segments / runs) for i in range(runs + 1)]
    counts = points.withColumn("counts", segment_counts(F.col("fp"), width))
    full = (1 << width) - 1
    own, above = [], []
    for r, (x, y) in enumerate(zip(ends, ends[1:])):
        mask = _signed(sum(full << width * i for i in range(x, y)))
        cell = F.col("counts").bitwiseAND(F.lit(mask))
        own.append(F.struct(F.lit(r).alias("run"), cell.alias("cell"), F.lit(False).alias("up")))
        for i in range(x, y) if reach else ():
            fits = F.shiftrightunsigned("counts", width * i).bitwiseAND(F.lit(full)) < width
            higher = F.shiftleft(F.shiftrightunsigned(cell, width * i) + 1, width * i).bitwiseOR(cell.bitwiseAND(F.lit(_signed((1 << width * i) - 1))))
            # a null cell joins with nothing
            above.append(F.struct(F.lit(r).alias("run"), F.when(fits, higher).alias("cell"), F.lit(True).alias("up")))
    there = counts.select("fp", "counts", F.inline(F.array(*own))).drop("up").alias("there")
    looks = counts.select("fp", "counts", F.inline(F.array(*own, *above))).where("cell is not null").alias("looks")
    bits = F.bit_count(F.col("looks.fp").bitwiseXOR(F.col("there.fp")))
    earlier = F.lit(True)
    for r in range(runs - 1):
        apart = manhattan(F.col("looks.counts"), F.col("there.counts"), width, ends[r], ends[r + 1]) > reach
        earlier = earlier & ((F.col("looks.run") <= r) | apart)
    near = (F.col("looks.run") == F.col("there.run")) & (F.col("looks.cell") == F.col("there.cell"))
    once = F.col("up") | (F.col("looks.fp") < F.col("there.fp"))
    met = looks.join(there, near & once & (bits <= most) & earlier)
    return met.select(F.least("looks.fp", "there.fp").alias("a"), F.greatest("looks.fp", "there.fp").alias("b"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_duplicates(docs: DataFrame, most: int = 3, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id, text_hash`` of every row.

    Rows whose fingerprints differ in ``most`` bits or fewer are linked; ``component_id`` is the
    smallest id reachable over links, the row's own included. Equal fingerprints (empty and null
    texts: all zero bits) are one class, of which one point takes part in the join, so a large group
    of copies costs no more than one document. A bit that is set in just half the hashes is 0. Texts of
    any length are taken whole, their hashes counted in runs. Repeated rows stay. A row with a null id
    is labelled with the smallest id of its class, null if there is none. Other columns are not read,
    whatever their names. An empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, words_each), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = connected_components(fingerprint_links(fps, most))
    linked = classes.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    # a class may hold a third of all rows, so the lookup is by a join that can be split or broadcast
    lookup = materialize(linked.join(named, "component").select("fp", "component_id"), "classes")
    return fps.join(lookup, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that bear their group's smallest id, with all their columns.

    Rows that agree in id and text leave one, any of them. Rows that share an id are judged each by its
    own text. Groups in which no row has an id keep all their different texts. Null and empty texts are
    one group. Texts are as long as they are, other columns stay whatever their names, and an empty
    table gives no rows.
    """
    groups = materialize(near_duplicates(docs, id_col=id_col, text_col=text_col, **options), "groups")
    i, h, n = unused(docs, "id", "hash", "n")
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).agg(F.count("*").alias(n))
    same = F.col(id_col).eqNullSafe(F.col(i)) & F.xxhash64(text_col).eqNullSafe(F.col(h))
    alone = docs.join(kept.where(F.col(n) == 1), same, "left_semi")
    # only rows of which there are several are compared with each other
    several = docs.join(kept.where(F.col(n) > 1), same, "left_semi").dropDuplicates([id_col, text_col])
    return alone.unionByName(several)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")
