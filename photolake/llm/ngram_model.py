"""Language-model scores by deleted interpolation of word n-gram estimates.

The counts never leave the executors: documents are cut into blocks of tokens, each block asks for
the corpus counts of its own distinct unigrams and bigrams, the requests are shuffled by hash range,
summed there, and the counts go back to the blocks. Only a histogram of fixed size reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photolake.llm.tables import fold, table
from photolake.llm.words import NO_SPACE, mixed, runs_of, words_of
from photolake.storage import materialize

#: Stands for the end of a document, and before its first word.
END = np.uint64(0xE7D55A10C0FFEE11)
#: Steps of the histogram for each doubling of a probability; cells reach 2**64 times the uniform estimate.
STEPS, CELLS = 4, 64 * 4
#: Buckets of context counts: 0, then one for each doubling.
BUCKETS = 40
#: Tasks of a shuffle at most; beyond, a task takes several groups one after another.
TASKS = 1 << 15


def _planes(x: np.ndarray) -> bytes:
    """64- or 32-bit numbers with their bytes dealt to planes, which compress well after differences."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def _unplanes(x: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _sorted_out(x: np.ndarray) -> bytes:
    return _planes(np.diff(x, prepend=np.uint64(0)))


def _sorted_in(x: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(x, "<u8"), dtype=np.uint64)


def _bigrams(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each token's bigram, the end mark standing before a document's first token."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first] = END
    return mixed(mixed(before) + tokens)


def _cut(docs: DataFrame, block_words: int) -> DataFrame:
    """Blocks of whole documents: ids, held-out marks, lengths, and each token as a place in ``vocab``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        ids, held, lengths, hashes, size = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            vocab, places = np.unique(np.concatenate(hashes), return_inverse=True)
            n, out = np.concatenate(lengths), np.concatenate(held)
            learned = int(n[~out].sum())
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + serial], pa.int64()), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)), pa.array([out.tobytes()]), pa.array([n.astype("<i8").tobytes()]), pa.array([_planes(places.astype("<u4").ravel())]), pa.array([_sorted_out(vocab)]), pa.array([size], pa.int64()), pa.array([learned], pa.int64()), pa.array([int((~out).sum())], pa.int64())],
                ["block", "ids", "held", "lengths", "tokens", "vocab", "n_tokens", "n_learned", "n_docs"],
            )

        for batch in batches:
            texts = batch.column(1).to_pylist()
            marks = np.array(batch.column(2).to_pylist(), bool)
            for a, b in runs_of(texts):
                w = words_of(texts[a:b], NO_SPACE)
                n = np.diff(w.first) + 1
                stream = np.full(int(n.sum()), END)
                ends = np.cumsum(n) - 1
                words = np.ones(len(stream), bool)
                words[ends] = False
                stream[words] = w.hash
                ids.append(batch.column(0).slice(a, b - a))
                held.append(marks[a:b])
                lengths.append(n)
                hashes.append(stream)
                size += len(stream)
                if size >= block_words:
                    yield block()
                    serial += 1
                    ids, held, lengths, hashes, size = [], [], [], [], 0
        if size:
            yield block()

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *(T.StructField(c, T.BinaryType()) for c in ("held", "lengths", "tokens", "vocab")), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_learned", "n_docs"))])
    return docs.mapInArrow(cut, schema)


def _opened(row: dict) -> tuple:
    """A block's token hashes, token places, vocabulary, first tokens, lengths, and marks of learned tokens."""
    vocab, places = _sorted_in(row["vocab"]), _unplanes(row["tokens"], "<u4")
    n = np.frombuffer(row["lengths"], "<i8")
    held = np.frombuffer(row["held"], bool)
    return vocab[places], places, vocab, np.cumsum(n) - n, n, np.repeat(~held, n), held


def _requests(blocks: DataFrame, buckets: int) -> DataFrame:
    """Each block's distinct n-grams, cut by hash range, with how often it has learned each."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, places, vocab, first, _, learned, _ = _opened(row)
                grams, at = np.unique(_bigrams(tokens, first), return_inverse=True)
                for kind, keys, which in ((1, vocab, places), (2, grams, at)):
                    counts = np.bincount(which[learned], minlength=len(keys)).astype("<u4")
                    edges = np.searchsorted(keys, np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)) if buckets > 1 else []
                    cuts = [0, *map(int, edges), len(keys)]
                    spans = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                    yield pa.RecordBatch.from_pydict({"gram": pa.array([kind] * len(spans), pa.int32()), "bucket": pa.array([i for i, _, _ in spans], pa.int32()), "block": pa.array([row["block"]] * len(spans), pa.int64()), "keys": pa.array([_sorted_out(keys[a:b]) for _, a, b in spans], pa.binary()), "counts": pa.array([_planes(counts[a:b]) for _, a, b in spans], pa.binary())})

    return blocks.select("block", "held", "lengths", "tokens", "vocab").mapInArrow(ask, "gram int, bucket int, block long, keys binary, counts binary")


def _answers(requests: DataFrame, buckets: int) -> DataFrame:
    """The summed counts of each request, and in one row of a bucket how many n-grams it has learned.

    Tasks follow the number of buckets, so that what one reads does not grow with the corpus.
    """

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        keys = [_sorted_in(r["keys"]) for r in rows]
        counts = np.concatenate([_unplanes(r["counts"], "<u4") for r in rows])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, weights=counts)
        ends = np.cumsum([len(k) for k in keys])
        distinct = int((sums > 0).sum())
        return pa.Table.from_pydict({"gram": pa.array([r["gram"] for r in rows], pa.int32()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "block": pa.array([r["block"] for r in rows], pa.int64()), "found": pa.array([_planes(sums[at[e - len(k) : e]].astype("<u8")) for k, e in zip(keys, ends)], pa.binary()), "distinct": pa.array([distinct if i == 0 else 0 for i in range(len(rows))], pa.int64())})

    return requests.repartition(min(2 * buckets, TASKS), "gram", "bucket").groupBy("gram", "bucket").applyInArrow(add, "gram int, bucket int, block long, found binary, distinct long")


def _counted(blocks: DataFrame, answers: DataFrame, n_blocks: int) -> DataFrame:
    """Documents with the corpus counts of each token and of its bigram, in tasks of about one block."""
    kind = blocks.schema["ids"].dataType.elementType

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                found = row.column("found").to_pylist()[0]
                one, two = (np.concatenate([_unplanes(r["found"], "<u8") for r in found if r["gram"] == k]) for k in (1, 2))
                tokens, places, _, first, n, _, held = _opened({c: row.column(c).to_pylist()[0] for c in ("held", "lengths", "tokens", "vocab")})
                one = one[places]
                _, at = np.unique(_bigrams(tokens, first), return_inverse=True)
                two = two[at]
                cuts = [(int(a), int(a + m)) for a, m in zip(first, n)]
                yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), pa.array(held), pa.array(n), pa.array([_planes(one[a:b]) for a, b in cuts], pa.binary()), pa.array([_planes(two[a:b]) for a, b in cuts], pa.binary())], ["doc_id", "held_out", "n_tokens", "one", "two"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("one", T.BinaryType()), T.StructField("two", T.BinaryType())])
    # a block's answers are as many numbers as it has different n-grams, so the list is bounded
    tasks = max(1, min(n_blocks, TASKS))
    found = answers.repartition(tasks, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("gram", "bucket", "found"))).alias("found"))
    return blocks.select("block", "ids", "held", "lengths", "tokens", "vocab").repartition(tasks, "block").join(found, "block").mapInArrow(look_up, schema)


def _counts_of(row: dict, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of a document's tokens, of their contexts, and of their bigrams."""
    one, two = _unplanes(row["one"], "<u8").astype(np.int64), _unplanes(row["two"], "<u8").astype(np.int64)
    context = np.empty_like(one)
    context[1:], context[0] = one[:-1], n_docs
    return one, context, two


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 1), 0)


def _histogram(counted: DataFrame, n: int, v: int, n_docs: int) -> list[tuple[int, int, int, int]]:
    """How often a learned token, itself left out, has which estimates: ``bucket, unigram, bigram, n``."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict = {}
        for batch in batches:
            rows = batch.to_pylist()
            for a in range(0, len(rows), 500):
                parts = [_counts_of(r, n_docs) for r in rows[a : a + 500]]
                one, context, two = (np.concatenate([p[i] for p in parts]) - 1 for i in range(3))
                with np.errstate(divide="ignore"):
                    p1 = np.log2(np.maximum(one, 0) / max(n - 1, 1) * (v + 1))
                    p2 = np.log2(np.where(context > 0, two / np.maximum(context, 1), 0) * (v + 1))
                q1, q2 = (np.where(np.isfinite(p), np.clip(np.rint(p * STEPS) + CELLS // 2, 1, CELLS - 1), 0).astype(np.int64) for p in (p1, p2))
                keys, times = np.unique((_bucket(context) * CELLS + q1) * CELLS + q2, return_counts=True)
                for k, c in zip(keys.tolist(), times.tolist()):
                    cells[k] = cells.get(k, 0) + c
        yield pa.RecordBatch.from_pydict({"cell": pa.array(list(cells), pa.int64()), "n": pa.array(list(cells.values()), pa.int64())})

    tallied = counted.where(~F.col("held_out")).select("one", "two").mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return [(c // CELLS // CELLS, c // CELLS % CELLS, c % CELLS, k) for c, k in tallied.collect()]


def fit_weights(cells: list[tuple[int, int, int, int]], rounds: int = 50) -> np.ndarray:
    """Expectation-maximisation of each bucket's weights of the uniform, unigram and bigram estimates.

    A bucket's weights start at, and with few tokens stay near, those of all buckets together.
    """
    weights = np.tile([0.1, 0.4, 0.5], (BUCKETS, 1))
    weights[0] = [0.2, 0.8, 0.0]
    if not cells:
        return weights
    bucket, q1, q2, times = np.array(cells, np.int64).T
    ratio = lambda q: np.where(q > 0, 2.0 ** ((q - CELLS // 2) / STEPS), 0)
    p = np.stack([np.ones(len(bucket)), ratio(q1), ratio(q2)], 1)
    pooled = np.array([0.1, 0.4, 0.5])
    for where, prior in ((np.zeros_like(bucket), 0.0), (bucket, 10.0)):
        w = np.tile(pooled, (BUCKETS, 1))
        for _ in range(rounds):
            share = w[where] * p
            share *= (times / share.sum(1))[:, None]
            total = np.zeros((BUCKETS, 3))
            np.add.at(total, where, share)
            total += prior * pooled
            w = np.where(total.sum(1, keepdims=True) > 0, total / np.maximum(total.sum(1, keepdims=True), 1e-300), w)
        pooled = w[0] if prior == 0 else pooled
        weights = w
    weights[0] = [weights[0][0], weights[0][1] + weights[0][2], 0.0]
    weights = np.maximum(weights, [1e-6, 1e-6, 0])
    return weights / weights.sum(1, keepdims=True)


def score(docs: DataFrame, held_out, block_words: int = 1 << 20, bucket_grams: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log10 probabilities of all texts under a bigram model of the rows that are not ``held_out``.

    Tokens are the words between ASCII white space, A-Z lowered, then one end mark. A token's
    probability mixes three maximum-likelihood estimates: uniform over the V learned tokens and one
    for all unknown, its share of the learned tokens, and its share of what followed its context (the
    token before; the end mark before the first). The weights depend on the bucket of the context's
    count. Expectation-maximisation learns them on the learned tokens with each taken out of its own
    counts (deleted estimation), over a histogram of the estimates that has a fixed number of cells.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. A null text is an
    empty one and has only its end; a text of any length stands whole in one block; repeated rows and
    null ids get rows of their own, and are learned from as often as they stand; other columns are not
    read, whatever their names; an empty table gives no rows. Where weights are equally likely, those
    of all buckets together decide. N-grams are told apart by 64-bit hashes.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    blocks = materialize(_cut(picked, block_words), "blocks")
    n_blocks, size, n, n_docs = blocks.agg(F.count("*"), *(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_learned", "n_docs"))).first()
    buckets = max(1, -(-size // bucket_grams))
    answers = materialize(_answers(_requests(blocks, buckets), buckets), "counts")
    v = answers.where("gram = 1").agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    counted = materialize(_counted(blocks, answers, n_blocks), "counted")
    weights = fit_weights(_histogram(counted, n, v, n_docs))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, base, total = [], [], []
            for row in batch.select(["one", "two"]).to_pylist():
                one, context, two = _counts_of(row, n_docs)
                w = weights[_bucket(context)]
                p = w[:, 0] / (v + 1) + w[:, 1] * one / max(n, 1) + w[:, 2] * two / np.maximum(context, 1)
                known.append(int((one > 0).sum()))
                base.append(float(np.log10((one + 1) / (n + v + 1)).sum()))
                total.append(float(np.log10(p).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(known, pa.int64()), pa.array([n] * batch.num_rows, pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = T.StructType([counted.schema["doc_id"], counted.schema["held_out"], counted.schema["n_tokens"], T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return counted.mapInArrow(rate, schema)


def op7_ngram_model(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those outside the fold."""
    return score(table(spark, sf_dir, "documents"), fold("doc_id") % 7 == 2)
