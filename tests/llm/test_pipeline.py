"""The pipeline against a plain version of its stages, each stage judged on its own input."""

import os
import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from photolake.llm import tokens, toxicity
from photolake.llm.tables import table
from photolake.storage import materialize
from tests.llm import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage."""
    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    docs, out = table(spark, sf_dir, "documents"), {}
    for name, stage in P.STAGES:
        made = materialize(stage(spark, docs, sf_dir), name)
        out[name] = (docs.collect(), made.collect(), made.columns)
        docs = made
    return sf_dir, out


def test_order_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash", "decontamination", "mixture", "token_files"]
    _, out = stages
    assert all(out[n][2] == COLUMNS for n, _ in P.STAGES[:-1])


def test_toxicity_drops_what_the_model_finds(spark, stages):
    sf_dir, out = stages
    before, after, _ = out["toxicity"]
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity.learned_rows())
    scores = model.scores([r.text for r in before])
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, s in zip(before, scores) if s < 0.5)
    assert len(after) > 0.7 * len(before)


def test_simhash_leaves_one_of_each_group(stages):
    before, after, _ = stages[1]["simhash"]
    groups = brute.simhash([(r.doc_id, r.text) for r in before])
    assert sorted(after) == sorted(r for r in before if groups[r.doc_id][1] == r.doc_id)


def test_decontamination_drops_what_holds_a_passage(spark, stages):
    sf_dir, out = stages
    before, after, _ = out["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    hit = {i: h for i, _, h, _ in brute.contamination([(r.doc_id, r.text) for r in before], items)}
    assert sorted(after) == sorted(r for r in before if not hit[r.doc_id])


def test_mixture_takes_each_source_to_its_target(stages):
    before, after, _ = stages[1]["mixture"]
    expected = {r[0]: r[4] for r in brute.mixture([(r.doc_id, r.text, r.source) for r in before]) if r[4]}
    found = {}
    for r in after:
        found[r.doc_id] = found.get(r.doc_id, 0) + len(brute.words(r.text, brute.NO_SPACE))
    assert found == expected


def test_token_files_hold_all_texts(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    before, after, _ = stages[1]["token_files"]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    expected = sorted((r.doc_id, crc([*t.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in before)
    assert sorted((r.doc_id, r.ids_crc32) for r in after) == expected
    rows = sorted(after, key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]


def test_token_files_follow_the_schedule_of_the_mix(spark, stages, tmp_path):
    """Documents stand as the slots deal them, so any stretch of the files holds the sources in their shares."""
    from photolake.llm import mixture

    sf_dir, out = stages
    docs = spark.createDataFrame(out["decontamination"][1])
    slots = mixture.mixed_documents(docs, slot_col="slot").collect()
    mixed = materialize(P.mix_sources(spark, docs, sf_dir), "mixed")
    rows = sorted(P.write_tokens(spark, mixed, sf_dir).collect(), key=lambda r: r.start)
    by_slot = {}
    for r in slots:
        by_slot.setdefault(r.doc_id, []).append(r.slot)
    # of two copies the earlier one has the earlier slot
    seen, order = {}, []
    for r in rows:
        order.append(sorted(by_slot[r.doc_id])[seen.setdefault(r.doc_id, 0)])
        seen[r.doc_id] += 1
    assert order == sorted(order) and len(order) == len(slots)
    assert [r.doc_id for r in rows] != sorted(r.doc_id for r in rows)
    # rows that come from no files have no order of their own
    some = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "doc_id long, text string")
    assert tokens.in_stored_order(some)[1] == ()
    assert [r.doc_id for r in sorted(P.write_tokens(spark, some, sf_dir).collect(), key=lambda r: r.start)] == [1, 2, 3]


def test_run_gives_what_the_stages_give(spark, stages):
    sf_dir, out = stages
    key = lambda rows: sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows)
    assert key(P.run(spark, sf_dir).collect()) == key(out["token_files"][1])


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None, 1), (1, "", "en", "a", 0, 2), (None, "some words here", "en", "a", 3, 3), (5, "a b c", None, None, None, 4), (5, "a b c", None, None, None, 4), (6, "x " * 9000, "en", "b", 1, 5)], "doc_id long, text string, lang string, source string, n_chars long, id int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "some words here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = [r.doc_id for r in P.run(spark, str(tmp_path)).collect()]
    assert set(found) <= {1, 5, 6} and found
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/empty/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/empty/{t}.parquet")
    assert P.run(spark, f"{tmp_path}/empty").count() == 0
