import hashlib
import random
import string
import zlib

import pytest
from pyspark.sql import functions as F

from photolake.llm import merkle
from tests.compare import same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def built(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        first = i // 8 * 8
        run = nodes[first : first + 8]
        out.append(("".join(run[: i - first]), "".join(run[i - first + 1 :])))
        i //= 8
    return out


def brute(rows, shown):
    """``(doc_id, leaf, subroot, root, proof, folded, verified)`` of rows ``doc_id, text, lang, source, n_chars``."""
    digest = lambda r, text: leaf(r[0], r[3], r[2], r[4], text)
    series = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of = {s: sorted((r for r in rows if r[2] == s), key=lambda r: (r[0] is not None, r[0] or 0, digest(r, r[1]))) for s in series}
    trees = {s: built([digest(r, r[1]) for r in of[s]]) for s in series}
    top = built([trees[s][-1][0] for s in series])
    out = []
    for k, s in enumerate(series):
        for i, r in enumerate(of[s]):
            proof, x = path(trees[s], i) + path(top, k), digest(r, shown(r))
            for a, b in proof:
                x = sha(a + x + b)
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in proof)), x, x == top[-1][0]))
    return sorted(out, key=str)


def third(r):
    hit = r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
    return r[1].translate(LOWER) if hit else r[1]


def found(spark, rows, schema=SCHEMA):
    lowered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))
    got = merkle.verified(spark.createDataFrame(rows, schema), {"text": lowered})
    return sorted((tuple(r) for r in got.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("n, parts", [(1, 4), (9, 4), (700, 37), (1200, 5)])
def test_against_a_plain_tree(spark, n, parts):
    """Parts begin and end anywhere, also within one run, and series are short and long."""
    rng = random.Random(n + parts)
    langs = ["en"] * 30 + ["de"] * 5 + [None, "é", "z" * 3]
    rows = [(i * 3, f"Text {i} " + "aB" * rng.randrange(5), rng.choice(langs), rng.choice(["a", None]), i) for i in range(n)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert found(spark, rows) == brute(rows, third)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_many_series_of_one_row(spark):
    rows = [(i, "x", f"l{i:03d}", "s", 1) for i in range(300)]
    assert found(spark, rows) == brute(rows, third)


def test_null_repeated_empty_and_long_rows(spark):
    long = "Word " * 300_000
    rows = [(None, None, None, None, None), (None, "A", None, None, 1), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (1, "B", "en", "s", 0), (2, long, "en", "s", 9), (3, None, "en", None, None)]
    rows += [(7, "Copy", "en", "s", 4)] * 20
    got = found(spark, rows)
    assert got == brute(rows, third)
    assert len(got) == len(rows)


def test_an_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == []
    names = "doc_id long, text string, lang string, source string, n_chars long, id string, leaf string, series long, range int, level int, note string"
    rows = [(i, f"T{i}", "en", "s", 2, "i", "l", 5, 1, 2, "n") for i in range(12)]
    assert found(spark, rows, names) == brute([r[:5] for r in rows], third)


def test_text_ids(spark):
    rows = [(f"k{i:02d}", "T", "en", "s", 1) for i in range(20)]
    assert found(spark, rows, SCHEMA.replace("doc_id long", "doc_id string")) == brute(rows, third)


def test_whole_proofs_lead_to_the_root_and_only_changed_rows_are_found_out(spark):
    rows = [(i, "Abc" if i % 2 else "abc", "en" if i % 5 else "fr", "s", 3) for i in range(100)]
    got = merkle.verified(spark.createDataFrame(rows, SCHEMA), {"text": F.lower("text")}).collect()
    for r in got:
        x = r.leaf
        for line in r.proof.split("\n"):
            before, behind = line.split(":")
            x = sha(before + x + behind)
        assert x == r.root
        assert r.verified == (r.id % 2 == 0)


def test_nodes_of_the_manifest(spark):
    rows = spark.range(1000).select(F.lit("one").alias("series"), "id", F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit("").alias("shown"))
    m = merkle.manifest(rows)
    levels = built([sha(str(i)) for i in range(1000)])
    nodes = {(r.level, r["index"]): r.digest for r in m.nodes.where("level > 0").collect()}
    assert nodes == {(n, i): x for n, level in enumerate(levels) if n for i, x in enumerate(level)}
    assert m.nodes.where("level > 0").count() == len(nodes)
    assert [r.subroot for r in m.roots.collect()] == levels[-1]


def test_the_query_gives_what_its_sql_gives(spark, sf_dir, duck):
    same(merkle.op11_merkle(spark, sf_dir).toPandas(), duck.execute(merkle.ORACLE_SQL).df())
