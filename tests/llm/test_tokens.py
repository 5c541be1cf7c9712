import random
import zlib

import numpy as np
import pytest

from photolake.llm import tokens
from photolake.storage import scratch_path

PIECES = ["word", "Wörter", "it's", "don't", "...", "\n\n", "\n", "  ", "\t", "123", "4,567", "<|endoftext|>", "日本語", "🙂", "x" * 50, "end.", "(so)", "a-b", "l'été", " ", " ", "ÀÉ", "_", "'", "'s", "\r\n", "x'", "A"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def texts(n=300, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) + rng.choice([" ", " ", " ", "", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def real(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def write(spark, rows, schema="doc_id long, text string", **options):
    folder = scratch_path(spark, "t")
    manifest = tokens.write_token_files(spark.createDataFrame(rows, schema), folder, **options)
    return folder, manifest, tokens.read_token_files(manifest, folder).collect()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_counts_of_all_documents(spark, sf_dir, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in tokens.op8_token_counts(spark, sf_dir).collect():
        n = len(real(tokenizer, docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((docs[r.doc_id] or "").encode()), n, n > 512)


def test_counts_of_odd_texts_in_parts(spark, tokenizer):
    rows = list(enumerate([*texts(), None, "", " ", "a b " * 5000, "<|endoftext|>" * 3, "x" * 3000]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.count_tokens(df, batch_bytes=500, part_chars=40).collect()}
    assert found == {i: (len((t or "").encode()), len(real(tokenizer, t))) for i, t in rows}


def test_counts_of_repeats_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (None, "b", 3), (None, None, 4)], "doc_id long, text string, n_tokens int")
    assert sorted(str(r.doc_id) + str(r.n_tokens) for r in tokens.count_tokens(df).collect()) == ["11", "11", "None0", "None1"]
    assert tokens.count_tokens(df.limit(0)).count() == 0


def test_files_of_all_documents(spark, sf_dir, tokenizer):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.op2_token_files(spark, sf_dir).collect()}
    start = 0
    for i, text in docs:
        ids = [*real(tokenizer, text), 2]
        assert found[i] == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(found) == len(docs)


def test_files_of_odd_texts(spark, tokenizer):
    rows = list(enumerate([*texts(seed=8), None, "", " ", "x\ny z", "a" * 9000 + " b"]))
    _, manifest, found = write(spark, rows[::-1], shards=5, run_bytes=300)
    by_id, start = {r.doc_id: r for r in found}, 0
    for i, text in rows:
        ids = [*real(tokenizer, text), 2]
        assert (by_id[i].start, by_id[i].n_tokens, by_id[i].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    m = manifest.orderBy("shard").collect()
    assert [r.token_base for r in m] == [sum(x.n_tokens for x in m[:k]) for k in range(len(m))]
    assert [r.doc_base for r in m] == [sum(x.n_docs for x in m[:k]) for k in range(len(m))]


def test_files_hold_what_the_format_says(spark, tokenizer):
    folder, manifest, _ = write(spark, [(3, "some words"), (1, "x"), (None, "null id")], shards=1)
    path = folder.removeprefix("file://")
    ids = np.fromfile(f"{path}/tokens-000000-0000.bin", "<u2").tolist()
    assert ids == [i for t in ("null id", "x", "some words") for i in [*real(tokenizer, t), 2]]
    assert np.fromfile(f"{path}/offsets-000000-0000.idx", "<i8").tolist()[-1] == len(ids)
    assert np.fromfile(f"{path}/ids-000000-0000.idx", "<i8").tolist() == [0, 1, 1, 0, 3, 0]


def test_files_of_repeats_nulls_and_nothing(spark):
    schema = "doc_id long, text string, shard int, id long"
    _, _, found = write(spark, [(1, "a", 1, 1), (1, "a", 1, 1), (None, None, 2, 2), (1, None, 3, 3)], schema)
    assert sorted((str(r.doc_id), r.start, r.n_tokens) for r in found) == [("1", 1, 1), ("1", 2, 2), ("1", 4, 2), ("None", 0, 1)]
    folder, manifest, found = write(spark, [], schema)
    assert found == [] and manifest.count() == 0


def test_one_id_with_many_rows_and_many_small_shards(spark, tokenizer):
    rows = [(None if i % 3 else 7, f"text {i} " * (i % 5)) for i in range(200)]
    _, manifest, found = write(spark, rows, shards=4, shard_bytes=100, run_bytes=50)
    assert manifest.select("shard").distinct().count() > 2 and manifest.where("piece > 0").count() > 4
    assert sorted(r.ids_crc32 for r in found) == sorted(crc([*real(tokenizer, t), 2]) for _, t in rows)
    found.sort(key=lambda r: r.start)
    assert [r.doc_id is None for r in found] == [True] * 133 + [False] * 67
    assert [r.start for r in found] == [sum(x.n_tokens for x in found[:k]) for k in range(len(found))]


def test_ids_that_are_no_numbers(spark):
    df = spark.createDataFrame([("b\n", "x"), ("a", "y y"), (None, "z")], "doc_id string, text string")
    folder = scratch_path(spark, "t")
    manifest = tokens.write_token_files(df, folder, shards=1)
    found = tokens.read_token_files(manifest, folder, "string").collect()
    assert [(r.doc_id, r.n_tokens) for r in found] == [(None, 2), ("a", 3), ("b\n", 2)]


@pytest.mark.parametrize("text", ["слово " * 500, "λέξη, " * 500, "日本語。" * 900, "1234 " * 500, "a<|endoftext|>" * 200, "x'll " * 300, "ab\n\n  cd" * 300, "½²_a!" * 400])
def test_long_texts_of_any_script_are_split(tokenizer, text):
    parts = tokens.split_safely(text, 100)
    assert "".join(parts) == text
    assert [i for p in parts for i in real(tokenizer, p)] == real(tokenizer, text)
    assert max(map(len, parts)) < 250 or not any(c in text for c in " \n。!")


def test_a_second_write_gives_the_same(spark):
    rows = [(i, t) for i, t in enumerate(texts(60, 5))]
    key = lambda found: sorted((r.doc_id, r.start, r.ids_crc32) for r in found)
    assert key(write(spark, rows, shards=3)[2]) == key(write(spark, rows[::-1], shards=7)[2])


def test_the_driver_loads_no_tokenizer_for_files(spark, monkeypatch):
    monkeypatch.setattr(tokens, "_TOKENIZERS", {})
    _, manifest, found = write(spark, [(1, "a b")])
    assert not tokens._TOKENIZERS
    assert [r.width for r in manifest.collect()] == ["<u2"] and [r.n_tokens for r in found] == [3]
