import random
from collections import Counter

import pytest

from photolake.llm import mixture
from tests.compare import same
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string"


def documents(n=200, seed=4):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * rng.choice([0, 1, 3, 20, 300])) + rng.choice(["", "\n", " z"]), rng.choice(["a", "a", "a", "b", "é", "Z", None])) for i in range(n)]


def mixed(spark, rows, **options):
    found = mixture.mix(spark.createDataFrame(rows, SCHEMA), **options).collect()
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken, r.slots[0] if r.slots else None) for r in found), key=str)


def expected(rows, **options):
    return sorted(((i, n, s, round(t, 6), k, f) for i, n, s, t, k, f in brute.mixture(rows, **options)), key=str)


def test_the_query_against_its_sql(spark, sf_dir, duck):
    same(mixture.op10_mixture(spark, sf_dir).toPandas(), duck.execute(mixture.ORACLE_SQL).df())


@pytest.mark.parametrize("seed, block, least", [(1, 64, 16), (2, 7, 1), (3, 4096, 1 << 14)])
def test_against_brute_force(spark, seed, block, least):
    rows = documents(seed=seed)
    found = mixed(spark, rows, block_words=block, least_slots=least)
    assert found == expected(rows, block_words=block, least_slots=least)
    assert all(k <= 2 * n for _, n, _, _, k, _ in found)


def test_targets_are_met_within_a_block_and_capped(spark):
    rows = documents(400, 9)
    by = {}
    for i, _, s, t, k, _ in mixed(spark, rows, block_words=16):
        by.setdefault((rows[i][2], s, t), []).append(k)
    for (_, size, target), taken in by.items():
        assert target <= 2 * size + 1e-6 and abs(sum(taken) - target) <= 32 and sum(taken) <= 2 * size
    assert abs(sum(t for _, _, t in by) - 1.5 * sum(s for _, s, _ in by)) < 1e-3


def schedule(spark):
    sized = spark.createDataFrame([("a", 900), ("b", 10_000), (None, 3000)], "source string, size long")
    sources = mixture.source_blocks(mixture.source_targets(sized, 1.5, (3, 1, 2), 2.0), 50)
    keys = -(-int(sources.agg({"high": "max"}).first()[0] * 65536) // 65536)
    return sources.collect(), mixture.schedule(sources, keys, cells=64).collect()


def test_any_stretch_of_the_schedule_holds_the_sources_in_their_shares(spark):
    sources, rows = schedule(spark)
    assert len({r.slot for r in rows}) == len(rows)
    wanted = {s.sid: s.high - s.low for s in sources}
    for s in sources:
        mine = sorted((r.slot, r.rank) for r in rows if r.sid == s.sid)
        assert [r for _, r in mine] == list(range(len(mine))) and abs(len(mine) - wanted[s.sid]) < 1
    order = sorted(rows, key=lambda r: r.slot)
    for start in range(0, len(order) - 64, 32):
        counts = Counter(r.sid for r in order[start : start + 64])
        for sid, n in wanted.items():
            assert abs(counts[sid] - 64 * n / sum(wanted.values())) < 6


def test_the_result_follows_the_schedule(spark, monkeypatch):
    rows = documents(80, 2)
    before = mixed(spark, rows, block_words=20)
    real = mixture.schedule
    monkeypatch.setattr(mixture, "schedule", lambda sources, keys: real(sources, keys).where("rank % 3 < 2"))
    thinner = mixed(spark, rows, block_words=20)
    assert sum(r[4] for r in thinner) < 0.8 * sum(r[4] for r in before)
    plain = lambda sources, keys: real(sources, keys).selectExpr("sid * 1000000 + rank as slot", "sid", "rank")
    monkeypatch.setattr(mixture, "schedule", plain)
    assert [r[5] for r in mixed(spark, rows, block_words=20)] != [r[5] for r in before]


def test_no_python_runs(spark, sf_dir):
    plan = mixture.op10_mixture(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_nulls_repeats_and_nothing(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "x y", None), (3, "x y", None), (None, "z", "a"), (None, None, None)]
    assert mixed(spark, rows) == expected(rows)
    assert mixed(spark, []) == []
    assert mixed(spark, [(1, None, None)]) == [(1, 0, 0, 0.0, 0, None)]


def test_one_source_and_one_very_long_text(spark):
    rows = [(1, "w " * 200_000, "a"), (2, "x", "b")]
    assert mixed(spark, rows) == expected(rows)


def test_mixed_documents_bear_the_words_taken_in_order_of_slots(spark):
    schema = "doc_id long, text string, source string, taken string, size int, id int, turn int"
    rows = [(*r, "x", 5, 6, 7) for r in documents(80, 5)]
    df = spark.createDataFrame(rows, schema)
    out = mixture.mixed_documents(df, "slot", block_words=16)
    assert out.columns == [*df.columns, "slot"]
    words, slots = {}, []
    for r in out.collect():
        assert (r.taken, r["size"], r.id, r.turn) == ("x", 5, 6, 7)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(brute.words(r.text, brute.NO_SPACE))
        slots.append(r.slot)
    assert slots == sorted(slots)
    assert words == {r[0]: r[4] for r in brute.mixture([r[:3] for r in rows], block_words=16) if r[4]}
    assert mixture.mixed_documents(df).columns == df.columns


def test_rows_that_share_an_id_share_what_is_taken_once(spark):
    rows = [(7, "a b\n c " * 25, "x"), (7, "a b\n c " * 25, "x"), (7, "d " * 40, "x"), (None, "e " * 60, "x"), (None, "f " * 60, None), (8, "g " * 300, "y")]
    out = mixture.mixed_documents(spark.createDataFrame(rows, SCHEMA), block_words=9).collect()
    plan = brute.mixture(rows, block_words=9)
    for key in {(r[0], rows[k][2]) for k, r in enumerate(plan)}:
        took = sum(r[4] for k, r in enumerate(plan) if (r[0], rows[k][2]) == key)
        assert sum(len(brute.words(r.text, brute.NO_SPACE)) for r in out if (r.doc_id, r.source) == key) == took
    # what is left over comes once, and with its line ends
    assert all(r.text == rows[0][1] or rows[0][1].startswith(r.text) for r in out if r.text.startswith("a"))
    assert sum(r.text != rows[0][1] for r in out if r.text.startswith("a")) <= 1


def test_mixed_documents_of_nothing(spark):
    assert mixture.mixed_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixture.mixed_documents(spark.createDataFrame([(1, None, None), (None, " ", "a")], SCHEMA)).count() == 0


def test_nothing_is_planned_for_shared_ids_where_there_are_none(spark, monkeypatch):
    written, materialize = [], mixture.materialize
    monkeypatch.setattr(mixture, "materialize", lambda df, name: (written.append(name), materialize(df, name))[1])
    rows = documents(30)
    once = mixture.mixed_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert once and "shared" not in written
    mixture.mixed_documents(spark.createDataFrame([*rows, rows[4], rows[5]], SCHEMA)).collect()
    assert "shared" in written
