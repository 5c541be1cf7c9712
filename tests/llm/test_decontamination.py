import random
import time

import numpy as np
import pytest

from photolake.llm import suffix_match
from tests.compare import same
from tests.llm import brute


def digest(spark, docs, items, **options):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = suffix_match.find_contamination(d, b, **options).collect()
    out = []
    for r in found:
        out.append((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.n_items, r.items_sha256))
    return sorted(out, key=str)


def digested(rows):
    """Rows with the number and digest of their items."""
    return sorted(((i, n, h, len(x), brute.sha(x)) for i, n, h, x in rows), key=str)


def drawn(seed, n_docs=60, n_items=15):
    """Texts over few words, so that windows occur often, overlap and stand next to each other."""
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choices("ab cd ef gh".split(), k=k))
    items = [(i, text(rng.choice([0, 1, 3, 4, 5, 9]))) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        t = text(rng.randint(0, 40))
        docs.append((i, t + (" " + rng.choice(items)[1]) * rng.randint(0, 2) + rng.choice(["", ".", " É,"])))
    return docs, items


def test_all_documents_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in suffix_match.op3_decontamination(spark, sf_dir).collect()}
    assert found == {i: (n, h, len(x), brute.sha(x), h > 0) for i, n, h, x in brute.contamination(docs, items)}
    assert any(v[4] for v in found.values())


def test_the_query_against_its_sql(spark, sf_dir, duck):
    same(suffix_match.op3_decontamination(spark, sf_dir).toPandas(), duck.execute(suffix_match.ORACLE_SQL).df())


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("test_words", [1 << 20, 25])
def test_windows_against_brute_force(spark, seed, test_words):
    docs, items = drawn(seed)
    assert digest(spark, docs, items, window=4, test_words=test_words) == digested(brute.contamination(docs, items, 4))


def test_longest_matches_have_places(spark):
    item = [f"q{i}" for i in range(15)]
    docs = [(1, "before it " + " ".join(item[2:14]) + " after"), (2, "nothing")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(8, " ".join(item))], "item_id long, text string")
    one = {r.doc_id: r for r in suffix_match.find_contamination(d, b).collect()}[1]
    assert [(m.item_id, m.start, m.item_start, m.words) for m in one.matches] == [(8, 2, 2, 12)]
    assert [(s.start, s.end) for s in one.spans] == [(2, 14)]
    assert [r.doc_id for r in suffix_match.decontaminate(d, b).collect()] == [2]


def test_suffixes_are_ranked_by_their_first_words():
    rng = random.Random(7)
    texts = [[rng.randint(1, 3) for _ in range(rng.randint(0, 12))] for _ in range(30)]
    flat = np.array([x for t in texts for x in t], np.uint64)
    end = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    for depth in (1, 2, 3, 5, 10):
        keys = [tuple(t[i : i + depth]) for t in texts for i in range(len(t))]
        order = {k: n + 1 for n, k in enumerate(sorted(set(keys)))}
        assert suffix_match.ranked_suffixes(flat, end, depth).tolist() == [order[k] for k in keys]


@pytest.mark.parametrize("seed", [11, 12])
def test_longest_matches_against_brute_force(spark, seed):
    docs, items = drawn(seed, 30, 8)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = suffix_match.find_contamination(d, b, window=4).collect()
    found = sorted((r.doc_id, m.start, m.words, m.places) for r in rows for m in r.matches)
    parsed = {k: brute.words(text) for k, text in items}
    real = []
    for i, t in docs:
        w, before = brute.words(t), 0
        for p in range(len(w)):
            reach = []
            for x in parsed.values():
                for q in range(len(x) - 3):
                    n = 0
                    while p + n < len(w) and q + n < len(x) and w[p + n] == x[q + n]:
                        n += 1
                    reach.append(n)
            most = max(reach, default=0)
            if most >= 4 and before != most + 1:
                real.append((i, p, most, reach.count(most)))
            before = most
            for n in (1, 2, 3):
                whole = sum(len(x) == n and w[p : p + n] == x for x in parsed.values())
                if whole:
                    real.append((i, p, n, whole))
    assert found == sorted(real) and len(real) > 20
    # the place that is told has the match
    words = {i: brute.words(t) for i, t in docs}
    for r in rows:
        for m in r.matches:
            assert parsed[m.item_id][m.item_start : m.item_start + m.words] == words[r.doc_id][m.start : m.start + m.words]


def test_one_word_repeated_and_a_passage_that_all_share(spark):
    """Time and memory grow with the words, not with pairs of places or of documents and items."""
    begun = time.monotonic()
    found = digest(spark, [(1, "no " * 100_000), (2, "yes")], [(7, "no " * 20_000), (8, "no no")])
    assert found == digested([(1, 100_000, 100_000, ["7", "8"]), (2, 1, 0, [])])
    passage = " ".join(f"p{i}" for i in range(30))
    docs, items = [(i, f"d{i} {passage} e{i}") for i in range(1000)], [(i, f"a{i} {passage} b{i}") for i in range(1000)]
    names = sorted(str(i) for i in range(1000))
    assert digest(spark, docs, items) == digested([(i, 32, 30, names) for i in range(1000)])
    assert time.monotonic() - begun < 60


def test_words_decide_and_not_hashes(spark, monkeypatch):
    real = suffix_match.words_of
    monkeypatch.setattr(suffix_match, "words_of", lambda texts, kind: real(texts, kind)._replace(hash=np.full(len(real(texts, kind).hash), 5, np.uint64)))
    tests = suffix_match.test_suffixes([(1, "a b c")], 3)
    (_, _, f), = suffix_match.search(["a b c", "x b c", "a b"], tests)
    assert f.n_hit.tolist() == [3, 0, 0]


def test_nulls_repeats_and_empty_tables(spark):
    docs = [(1, None), (1, ""), (2, "Short ITEM."), (2, "Short ITEM."), (None, "short item")]
    items = [(5, "short item"), (5, "short item"), (None, "short item"), (6, None), (7, "")]
    found = digest(spark, docs, items)
    assert found == digested([(1, 0, 0, []), (1, 0, 0, []), (2, 2, 2, ["5"]), (2, 2, 2, ["5"]), (None, 2, 2, ["5"])])
    assert digest(spark, docs, items, test_words=1) == found
    assert digest(spark, [], items) == []
    assert all(h == 0 for _, _, h, *_ in digest(spark, docs, []))


def test_other_columns_stay(spark):
    d = spark.createDataFrame([(1, "one two", "x", 3), (2, "three four", None, None)], "doc_id long, text string, text_hash string, spans int")
    b = spark.createDataFrame([(1, "one two", "y")], "item_id long, text string, doc_id string")
    kept = suffix_match.decontaminate(d, b)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [2]


def test_a_very_long_text(spark):
    long = " ".join(f"t{i}" for i in range(700_000))
    passage = " ".join(f"t{i}" for i in range(399_990, 400_010))
    found = digest(spark, [(1, long), (2, "t1 t2")], [(3, passage)])
    assert found == digested([(1, 700_000, 20, ["3"]), (2, 2, 0, [])])
