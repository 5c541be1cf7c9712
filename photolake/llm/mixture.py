"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from photolake.llm.tables import table, unused
from photolake.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Between two words, and between a word and what stands before or behind it.
EDGE = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])|(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
#: Parts of a slot in which weights are counted, so that their sums are exact whatever their order.
GRAIN = 65_536


def source_targets(sized: DataFrame, share: float, weights: tuple[float, ...], most: float) -> DataFrame:
    """``source, sid, source_size, target`` for ``source, size`` rows.

    Sources are numbered by code point, null last, and take ``weights`` in turn. All share ``share``
    times the words there are; none gets more than ``most`` times its own, and what is over goes to
    the rest by weight until none is above. A source with cap c and weight w is full when c / w is
    below the level at which the others stand, so one pass in the order of c / w settles all.
    One row for each source is windowed.
    """
    all_rows, in_turn = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_level = Window.partitionBy(F.lit(0)).orderBy("level", "sid")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(in_turn) - 1)
    s = s.withColumn("weight", F.get(cycle, F.col("sid") % len(weights))).withColumn("cap", F.col("source_size") * most)
    s = s.withColumn("level", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(all_rows) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("rank", F.row_number().over(by_level)).withColumn("stand", left / weight_left)
    s = s.withColumn("at", F.min_by(F.when(F.col("level") >= F.col("stand"), F.col("stand")), F.when(F.col("level") >= F.col("stand"), F.col("rank"))).over(all_rows))
    s = s.withColumn("target", F.when((F.col("level") < F.col("stand")) | F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("at"))))
    return s.select("source", "sid", "source_size", "target")


def block_size(words: int, block_words: int, least_slots: int) -> int:
    """Words of a block: ``block_words``, or fewer, so that the mix has ``least_slots`` slots at least."""
    return max(1, min(block_words, words // least_slots))


def source_blocks(targets: DataFrame, words: int) -> DataFrame:
    """``targets`` with each source's equal blocks of about ``words`` words, and its part of the slots.

    ``block_words`` is the size and ``blocks`` the number of a source's blocks. The source wants
    ``target / source_size`` of its blocks, so its keys are those from ``low`` up to, not including,
    ``high``: cumulative weights in units of one block.
    """
    size = F.ceil(F.col("source_size") / F.ceil(F.col("source_size") / words)).cast("long")
    s = targets.withColumn("block_words", F.when(F.col("source_size") > 0, size).otherwise(1))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
    wanted = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.col("blocks") * GRAIN) / GRAIN).otherwise(0.0)
    s = s.withColumn("wanted", wanted).withColumn("high", F.sum("wanted").over(Window.partitionBy(F.lit(0)).orderBy("sid")))
    return s.withColumn("low", F.col("high") - F.col("wanted")).drop("wanted")


def van_der_corput(key: Column, bits: int) -> Column:
    """The place of a key among ``2 ** bits`` points of the van der Corput sequence: its bits reversed.

    Point n of the sequence, times ``2 ** bits``, is the number with the bits of n reversed; so the
    point that falls on ``key`` is the one of number ``van_der_corput(key)``.
    """
    return F.conv(F.reverse(F.lpad(F.bin(key), bits, "0")), 2, 10).cast("long")


def schedule(sources: DataFrame, keys: int, cells: int = 4096) -> DataFrame:
    """``slot, sid, rank``: which source the mix takes a block of at each slot, and its how many-th.

    Slot n has the van der Corput point n. ``keys`` is the sum of all weights in blocks; the points
    are spread over the least power of two that holds it, mapped through the cumulative weights
    ``low, high``, and slots whose point lies beyond all weights stay empty. So any stretch of slots
    holds the sources in their shares, and a source gets its weight, rounded down or up, in all.
    Sources are found by an equi-join over ``cells`` cells of keys. A source's slots are ranked in
    two steps, within runs of slots and over the runs' counts, both of which grow with the square root
    of the slots, so no task ever ranks all slots of one source.
    """
    bits = max(1, (keys - 1).bit_length())
    run, width = 1 << -(-bits // 2), max(1, -(-keys // cells))
    spans = sources.where("high > low").select("sid", F.ceil("low").alias("from"), F.ceil("high").alias("to")).where("to > from")
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor((F.col("to") - 1) / width))))
    points = sources.sparkSession.range(keys).select(F.col("id").alias("key"), F.floor(F.col("id") / width).alias("cell"))
    points = points.join(spans, "cell").where(F.col("key") >= F.col("from")).where(F.col("key") < F.col("to"))
    points = points.select("sid", van_der_corput(F.col("key"), bits).alias("slot")).withColumn("run", F.floor(F.col("slot") / run))
    counts = points.groupBy("sid", "run").agg(F.count("*").alias("n"))
    base = counts.select("sid", "run", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1
    return points.withColumn("within", within).join(base, ["sid", "run"]).select("slot", "sid", (F.col("base") + F.col("within")).alias("rank"))


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: float = 2.0, block_words: int = 4096, least_slots: int = 1 << 14, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, slots`` of every row.

    ``size`` counts words (runs without ASCII white space). A source's rows stand end to end in the
    order of their ids' MD5, which shuffles them alike on every run. That line is cut into equal
    blocks of at most ``block_words`` words, of fewer where the mix would have less than
    ``least_slots`` slots. :func:`schedule` decides how many blocks a source gives and in which
    slots: the block of rank r is block r of the line, or r less the number of blocks in the second
    turn. ``taken`` are the words of the row in the blocks taken, ``slots`` the first slot of each
    turn that takes some of them, in order. So a source's words differ from its target by less than
    a block or two, and no row exceeds ``most`` times its size.

    Places in the line are prefix sums in three steps, over 4096 parts of each source by the MD5's first
    digits, over 64 deals of each by size, and within them, so a source or an id may hold any part of the rows;
    rows equal in id, source and size stand side by side. A text of any length is a row of the blocks
    it reaches. A null text has size 0, a null source is a source of its own, null ids stand where an
    empty id would, rows of one id and size in any order, as they give the same rows; repeated rows are
    rows of their own; other columns are not read; an empty table gives no rows.
    """
    turns = int(-(-most // 1))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0))
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")), "sized")
    targets = materialize(source_targets(sized, share, weights, most), "targets")
    words = int(targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0])
    sources = materialize(source_blocks(targets, block_size(words, block_words, least_slots)), "sources")
    keys = int(sources.agg(F.coalesce(F.ceil(F.max("high")), F.lit(0))).first()[0])
    names = sources.select(F.col("source").alias("name"), "sid", "source_size", "target", "block_words", "blocks")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = sized.join(names, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("key", key)
    rows = rows.withColumn("part", F.substring("key", 1, 3)).withColumn("deal", F.pmod("size", F.lit(64)))
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    deals = rows.groupBy("sid", "part", "deal").agg(F.sum("size").alias("n"))
    parts = deals.groupBy("sid", "part").agg(F.sum("n").alias("n")).select("sid", "part", F.coalesce(F.sum("n").over(upto("sid", "part")), F.lit(0)).alias("before"))
    deals = deals.withColumn("base", F.coalesce(F.sum("n").over(upto("sid", "part", "deal")), F.lit(0)))
    base = deals.join(parts, ["sid", "part"]).select("sid", "part", "deal", (F.col("before") + F.col("base")).alias("base"))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("sid", "part", "deal").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.where("size > 0").withColumn("within", within).join(base, ["sid", "part", "deal"]).withColumn("start", F.col("base") + F.col("within"))
    placed = placed.select("doc_id", "source", "size", "source_size", "target", "sid", "start", "block_words", "blocks")
    reached = F.sequence(F.floor(F.col("start") / F.col("block_words")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block_words")))
    laid = placed.withColumn("block", F.explode(reached)).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    laid = laid.withColumn("rank", F.col("turn") * F.col("blocks") + F.col("block"))
    laid = laid.withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("block_words")) - F.greatest(F.col("start"), F.col("block") * F.col("block_words")))
    cut = laid.select("sid", "rank", "start", "turn", "words").join(schedule(sources, keys), ["sid", "rank"])
    by_turn = cut.groupBy("sid", "start", "turn").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    taken = by_turn.groupBy("sid", "start").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list("slot")).alias("slots"))
    none = F.array().cast("array<bigint>")
    full = placed.join(taken, ["sid", "start"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("slots", none).alias("slots"))
    empty = rows.where("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), none.alias("slots"))
    return full.unionByName(empty)


def _first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its ``n``-th word, with what stands between the words."""
    pieces = F.split(text, EDGE)
    led = F.when(F.get(pieces, 0).rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    return F.array_join(F.slice(pieces, 1, (2 * n - 1 + led).cast("int")), "")


def mixed_documents(docs: DataFrame, slot_col: str | None = None, **options) -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix` takes them, all columns kept, in the order of their slots.

    A row comes once for each whole time that its words are taken, and once more with its first words
    only, as they stand in the text, where a part is left over. Its n-th copy stands at the slot of
    its n-th turn; the slot is given as ``slot_col`` if that is named, and rows are dealt by ranges of
    it and sorted within them. Rows of which nothing is taken go; rows without a word go too.

    Rows that share id and source are told apart by their size; of those that share it too, all words
    taken are dealt out once: whole copies in turn, then the part that is left over to a single row.
    They are numbered in two steps, within the written parts of the rows and over the parts' counts.
    Where no rows share both, nothing is planned for it, as every stage takes some of the driver's memory.
    """
    id_col, text_col, source_col = options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("source_col", "source")
    i, s, n, taken, size, slots, rows_of, turn, part, c, by_size, by_part, slot = unused(docs, "id", "origin", "n", "taken", "size", "slots", "rows", "turn", "part", "c", "by_size", "by_part", slot_col or "slot")
    plan = materialize(mix(docs, **options), "plan")
    by_row = plan.groupBy(F.col("doc_id").alias(i), F.col("source").alias(s)).agg(F.count("*").alias(c), F.first("size").alias(size), F.sum("taken").alias(taken), F.first("slots").alias(slots))
    by_row = materialize(by_row, "planned")
    same = F.col(id_col).eqNullSafe(F.col(i)) & F.col(source_col).eqNullSafe(F.col(s))
    alone = docs.join(by_row.where((F.col(c) == 1) & (F.col(taken) > 0)).drop(c), same).withColumn(rows_of, F.lit(1).cast("long")).withColumn(n, F.lit(0).cast("long"))
    rows = alone
    if not by_row.where(F.col(c) > 1).isEmpty():
        counted = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0))
        shared = materialize(docs.join(by_row.where(F.col(c) > 1).select(i, s), same, "left_semi").withColumn(size, counted).withColumn(part, F.spark_partition_id()), "shared")
        key = [F.col(id_col), F.col(source_col), F.col(size)]
        sums = shared.groupBy(F.col(id_col).alias(i), F.col(source_col).alias(s), F.col(size).alias(by_size), F.col(part).alias(by_part)).agg(F.count("*").alias(c))
        before = Window.partitionBy(i, s, by_size).orderBy(by_part).rowsBetween(Window.unboundedPreceding, -1)
        base = sums.withColumn(c, F.coalesce(F.sum(c).over(before), F.lit(0)))
        of = plan.groupBy(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("size").alias(by_size)).agg(F.count("*").alias(rows_of), F.sum("taken").alias(taken), F.max("slots").alias(slots)).where(F.col(taken) > 0)
        numbered = shared.withColumn(n, F.row_number().over(Window.partitionBy(*key, part).orderBy(F.lit(0))) - 1)
        both = numbered.join(base, same & (F.col(size) == F.col(by_size)) & (F.col(part) == F.col(by_part))).withColumn(n, F.col(n) + F.col(c)).drop(i, s, c, part, by_size, by_part)
        both = both.join(of, same & (F.col(size) == F.col(by_size))).drop(by_size)
        rows = alone.unionByName(both)
    whole = F.floor(F.col(taken) / F.col(size))
    own = F.floor(whole / F.col(rows_of)) + F.when(F.col(n) < whole % F.col(rows_of), 1).otherwise(0)
    left = F.when(F.col(n) == whole % F.col(rows_of), F.col(taken) - whole * F.col(size)).otherwise(0)
    rows = rows.withColumn(c, own).withColumn(part, left)
    times = F.col(c) + F.when(F.col(part) > 0, 1).otherwise(0)
    rows = rows.where(times > 0).withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), times)))
    copies = rows.withColumn(text_col, F.when(F.col(turn) <= F.col(c), F.col(text_col)).otherwise(_first_words(F.col(text_col), F.col(part))))
    copies = copies.withColumn(slot, F.get(slots, (F.least(F.col(turn), F.size(slots)) - 1).cast("int")))
    dealt = copies.select(*docs.columns, slot)
    dealt = dealt.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), slot).sortWithinPartitions(slot)
    return dealt if slot_col else dealt.select(*docs.columns)


def op10_mixture(spark, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, and the slot at which it first does."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.get("slots", F.lit(0)).alias("first_slot"))


ORACLE_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), n as (
  select *, row_number() over (order by source nulls last) - 1 as sid from s
), w as (
  select *, case sid % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight, source_size * 2.0::double as cap from n
), l as (
  select *, sum(source_size) over () * 1.5::double as words, sum(weight) over () as all_weight, cap / weight as level,
    coalesce(sum(cap) over (order by cap / weight, sid rows between unbounded preceding and 1 preceding), 0) as cap_before,
    coalesce(sum(weight) over (order by cap / weight, sid rows between unbounded preceding and 1 preceding), 0) as weight_before
  from w
), v as (
  select *, (words - cap_before) / (all_weight - weight_before) as stand from l
), f as (
  select *, (select arg_min(stand, level) from v where level >= stand) as settled from v
), t as (
  select source, sid, source_size, case when level < stand or settled is null then cap else least(cap, weight * settled) end as target from f
), e as (
  select *, greatest(1, least(4096, floor(floor(sum(target) over ()) / 16384)::bigint)) as about from t
), g as (
  select *, case when source_size > 0 then ceil(source_size / ceil(source_size / about))::bigint else 1 end as each from e
), b as (
  select *, ceil(source_size / each)::bigint as blocks from g
), c as (
  select *, case when source_size > 0 then floor(target / source_size * blocks * 65536) / 65536 else 0 end as wanted from b
), a as (
  select *, sum(wanted) over (order by sid) as high, ceil(sum(wanted) over ())::bigint as keys from c
), k as (
  select key, greatest(1, length(bin(keys - 1))) as bits from (select unnest(range(max(keys))) as key, max(keys) as keys from a) where keys > 0
), p as (
  select sid, blocks, list_sum(list_transform(range(bits), lambda i: ((key >> i) & 1) << (bits - 1 - i)))::bigint as slot
  from k join a on key >= ceil(high - wanted) and key < ceil(high)
), r as (
  select sid, slot, row_number() over (partition by sid order by slot) - 1 as rank from p
), x as (
  select d.doc_id, d.size, a.*,
    coalesce(sum(d.size) over (partition by a.sid order by substr(md5(coalesce(cast(d.doc_id as varchar), '')), 1, 3), d.size % 64, md5(coalesce(cast(d.doc_id as varchar), '')), d.size rows between unbounded preceding and 1 preceding), 0)::bigint as start,
    row_number() over () as id
  from d join a on d.source is not distinct from a.source
), y as (
  select *, unnest(range(start // each, (start + size - 1) // each + 1)) as block from x where size > 0
), z as (
  select y.id, sum(least(start + size, (block + 1) * each) - greatest(start, block * each))::bigint as taken, min(slot) as first_slot
  from y cross join (values (0), (1)) u(turn) join r on r.sid = y.sid and r.rank = turn * blocks + block group by y.id
)
select doc_id, size, source_size, target, coalesce(taken, 0) as taken, first_slot from x left join z using (id)
"""
