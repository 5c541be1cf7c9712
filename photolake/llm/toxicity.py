"""Toxicity by a convolutional text classifier, trained by all labelled documents in tasks that work in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from photolake.llm.samples import labelled_sample, marked_rows
from photolake.llm.tables import fold, table
from photolake.llm.words import ALNUM, runs_of, words_of
from photolake.storage import discard, materialize

#: Frequent words by which a text's language is guessed, for its threshold.
LANGUAGES = {
    "en": "the of and to in is that for with",
    "de": "der die und das den von zu mit ist",
    "fr": "le la les des et du un pour que",
    "es": "el los las de y en por una con",
}
WIDTHS = (1, 2, 3)
#: Empty places behind each document. A window begins at a word or at the first of them, so that no
#: window reaches the next document and a document without words has one.
PAD = max(WIDTHS)
#: Tokens convolved at once.
RUN = 1 << 17
#: Documents that one task learns from in a line, shards at most, and rows of the embedding that are sent together.
EACH, SHARDS, BLOCK = 65_536, 256, 1024


@dataclass
class ConvModel:
    """Hashed embeddings, filters and the output layer, and a threshold for each language.

    A word's bucket is the low bits of its hash. A bucket holds the commonest training word that
    falls there; a 32-bit tag tells it from other words, which all share the zero vector in row 0.
    """

    row: np.ndarray
    tag: np.ndarray
    embedding: np.ndarray
    filters: list
    bias: list
    out: np.ndarray
    out_bias: float
    language: np.ndarray
    thresholds: np.ndarray
    folded: list = field(default_factory=list)

    def __getstate__(self) -> dict:
        """Without what :meth:`fold_in` makes, which is several times larger and made anew where it is needed."""
        return self.__dict__ | {"folded": []}

    def rows_of(self, hashes: np.ndarray) -> np.ndarray:
        bucket = (hashes & np.uint64(len(self.row) - 1)).astype(np.int64)
        return np.where(self.tag[bucket] == (hashes >> np.uint64(32)).astype(np.uint32), self.row[bucket], 0)

    def fold_in(self) -> None:
        """Each filter's value at each of its places for every embedding row, so that scoring only adds."""
        self.folded = [[(self.embedding @ f).astype(np.float32) for f in fs] for fs in self.filters]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores from 0 to 1 of all texts; 0.5 is the threshold of the guessed language."""
        out = [np.zeros(0)]
        for a, b in runs_of(texts):
            w = words_of(texts[a:b], ALNUM)
            z, language = self.outputs(*padded(self.rows_of(w.hash), w.first))
            out.append(1 / (1 + np.exp(-np.clip(z - self.thresholds[language], -30, 30))))
        return np.concatenate(out)

    def outputs(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the output layer gives for each padded document, before its threshold, and its language."""
        if not self.folded:
            self.fold_in()
        return np.maximum(self._pooled(rows, first), 0) @ self.out + self.out_bias, self.languages(rows, first)

    def _pooled(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The largest value of every filter in each document, taken run by run."""
        n, docs = len(rows), len(first) - 1
        # places at which no window begins count for a row that is left out
        pooled = np.full((docs + 1, len(self.out)), -np.inf, np.float32)
        doc_of = np.repeat(np.arange(docs), np.diff(first))
        for k in range(1, PAD):
            doc_of[first[1:] - k] = docs
        tail = np.concatenate([rows, np.zeros(PAD, rows.dtype)])
        for a in range(0, n, RUN):
            b = min(n, a + RUN)
            heads = np.flatnonzero(np.diff(doc_of[a:b], prepend=-1))
            at = 0
            for tables, bias in zip(self.folded, self.bias):
                value = tables[0][tail[a:b]]
                for o in range(1, len(tables)):
                    value += tables[o][tail[a + o : b + o]]
                best = np.maximum.reduceat(value, heads, axis=0) + bias
                to = pooled[doc_of[a:b][heads], at : at + len(bias)]
                pooled[doc_of[a:b][heads], at : at + len(bias)] = np.maximum(to, best)
                at += len(bias)
        return pooled[:docs]

    def languages(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The language whose frequent words a document has most of; the last number for none."""
        k, docs = len(LANGUAGES), len(first) - 1
        spoken = self.language[rows]
        doc_of = np.repeat(np.arange(docs), np.diff(first))
        counts = np.bincount(doc_of[spoken < k] * k + spoken[spoken < k], minlength=docs * k).reshape(docs, k)
        return np.where(counts.max(1, initial=0) > 0, counts.argmax(1) if k else 0, k)


def padded(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with ``PAD`` zeros behind each document, and each document's first place."""
    n = np.diff(first)
    at = np.arange(len(rows)) + np.repeat(np.arange(len(n)) * PAD, n)
    out = np.zeros(len(rows) + PAD * len(n), np.int32)
    out[at] = rows
    return out, first + np.arange(len(n) + 1) * PAD


def _counted_words(texts: DataFrame) -> DataFrame:
    """``word, n``: the different words, as hashes, of each document, added up for some of them at a time."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(0).to_pylist()
            for a, b in runs_of(some):
                w = words_of(some[a:b], ALNUM)
                word, n = np.unique(np.concatenate([np.unique(w.hash[i:j]) for i, j in zip(w.first, w.first[1:])]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return texts.select("text").mapInArrow(words, "word long, n long")


def _vocabulary(texts: DataFrame, bits: int, min_docs: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets, tags and the number of rows; the commonest words have the smallest rows, from 1.

    Words are counted in Spark; the driver gets the commonest word of each of the 2**bits buckets.
    """
    counted = _counted_words(texts).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    bucket = F.col("word").bitwiseAND(F.lit((1 << bits) - 1))
    best = counted.groupBy(bucket.alias("bucket")).agg(F.max(F.struct("n", "word")).alias("w")).select("bucket", "w.word", "w.n").orderBy(F.desc("n"), "bucket").toArrow()
    at, words = (best[c].to_numpy() for c in ("bucket", "word"))
    row, tag = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.uint32)
    row[at] = np.arange(1, len(at) + 1)
    tag[at] = (words.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    return row, tag, len(at) + 1


def _bytes_of(rows: np.ndarray) -> bytes:
    """32-bit numbers as bytes, the lowest of all first, which packs better."""
    return np.ascontiguousarray(rows.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _rows_in(data: pa.Scalar) -> np.ndarray:
    planes = np.frombuffer(data.as_buffer(), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def shards_of(docs: int) -> int:
    """How many shards so many documents lie in: each sends what it moved after every epoch, so they are few."""
    return max(1, min(SHARDS, docs // EACH))


def _as_rows(texts: DataFrame, marks: DataFrame, model: ConvModel, shards: int) -> DataFrame:
    """``label, later, shard, rows`` of the labelled documents, each shard in one file and in an order of its own; ``later`` is a fifth.

    Texts stay where they are: only the numbers of their words' rows are dealt to the shards, where they
    meet the labels.
    """
    sent = texts.sparkSession.sparkContext.broadcast((model.row, model.tag))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, tag = sent.value
        known = ConvModel(row, tag, *[None] * 5, 0.0, None, None)
        for batch in batches:
            some = batch.column(1).to_pylist()
            for a, b in runs_of(some):
                w = words_of(some[a:b], ALNUM)
                rows = known.rows_of(w.hash)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([_bytes_of(rows[i:j]) for i, j in zip(w.first, w.first[1:])], pa.binary())], ["doc_id", "rows"])

    found = texts.select("doc_id", "text").mapInArrow(look_up, T.StructType([texts.schema["doc_id"], T.StructField("rows", T.BinaryType())]))
    met = found.repartition(shards, "doc_id").join(marks.repartition(shards, "doc_id").hint("shuffle_hash"), "doc_id")
    named = met.select("label", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 4).alias("later"), F.pmod(F.hash("doc_id"), F.lit(shards)).alias("shard"), "rows", F.xxhash64("doc_id").alias("place"), "doc_id")
    made = materialize(named.sortWithinPartitions("shard", "later", "place", "doc_id", "rows").drop("place", "doc_id"), "rows")
    sent.destroy()
    return made


def _odds(rows: DataFrame, size: int, ones: int, zeros: int, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of those that stand in ``min_docs`` labelled documents, 0 for the others, and the log-odds of each of standing in a document labelled 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, hits = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for some in batches:
            for label, data in zip(some.column(0).to_pylist(), some.column(1)):
                own = np.unique(_rows_in(data))
                n[own] += 1
                hits[own] += label
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, n[at], hits[at])], ["row", "n", "ones"])

    found = rows.select("label", "rows").mapInArrow(count, "row long, n long, ones long").groupBy("row").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).toArrow()
    n, hits = np.zeros(size), np.zeros(size)
    n[found["row"].to_numpy()], hits[found["row"].to_numpy()] = found["n"].to_numpy(), found["ones"].to_numpy()
    known = n >= min_docs
    known[0] = False
    odds = np.log((hits[known] + 0.5) / (ones + 1)) - np.log((n[known] - hits[known] + 0.5) / (zeros + 1))
    return np.where(known, np.cumsum(known), 0).astype(np.int32), np.concatenate([[0.0], odds])


@dataclass
class Fit:
    """All that training moves: embeddings with their squared gradients, the dense parameters with their moments, and the steps so far; ``row`` has the row of each word's number."""

    row: np.ndarray
    e: np.ndarray
    seen: np.ndarray
    dense: list
    moments: list
    steps: int

    def __getstate__(self) -> dict:
        """Embeddings are sent in single precision."""
        return self.__dict__ | {"e": self.e.astype(np.float32), "seen": self.seen.astype(np.float32)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"e": state["e"].astype(np.float64), "seen": state["seen"].astype(np.float64)}

    def copy(self) -> Fit:
        return Fit(self.row, self.e.copy(), self.seen.copy(), [x.copy() for x in self.dense], [(m.copy(), v.copy()) for m, v in self.moments], self.steps)

    def flat(self) -> np.ndarray:
        """The dense parameters, then their moments, in one line."""
        return np.concatenate([x.ravel() for x in (*self.dense, *(m for m, _ in self.moments), *(v for _, v in self.moments))])

    def unflatten(self, line: np.ndarray) -> None:
        at = 0
        for x in (*self.dense, *(m for m, _ in self.moments), *(v for _, v in self.moments)):
            x[...] = line[at : at + x.size].reshape(x.shape)
            at += x.size

    def filters(self) -> list:
        """The filters of each width, as they lie in ``dense``."""
        return [self.dense[sum(WIDTHS[:k]) : sum(WIDTHS[: k + 1])] for k in range(len(WIDTHS))]

    def peaks(self, seq: np.ndarray, first: np.ndarray) -> list:
        """Where each filter peaks in each padded document, found run by run in single precision."""
        docs, n = len(first) - 1, len(seq)
        width = len(self.dense[-2]) // len(WIDTHS)
        best = [np.full((docs, width), -np.inf, np.float32) for _ in WIDTHS]
        place = [np.zeros((docs, width), np.int64) for _ in WIDTHS]
        ahead = np.concatenate([seq, np.zeros(PAD, seq.dtype)])
        for a in range(0, n, RUN):
            b = min(n, a + RUN)
            x = self.e[ahead[a : b + PAD]].astype(np.float32)
            lo, hi = int(np.searchsorted(first, a, "right")) - 1, int(np.searchsorted(first, b, "left"))
            for k, fs in enumerate(self.filters()):
                value = x[: b - a] @ fs[0].astype(np.float32)
                for o in range(1, len(fs)):
                    value += x[o : o + b - a] @ fs[o].astype(np.float32)
                for j in range(lo, hi):
                    s, t = max(first[j], a), min(first[j + 1] - PAD + 1, b)
                    if s >= t:
                        continue
                    top = value[s - a : t - a].argmax(0)
                    most = value[s - a + top, np.arange(width)]
                    better = most > best[k][j]
                    best[k][j, better], place[k][j, better] = most[better], s + top[better]
        return place

    def step(self, parts: list, label: np.ndarray, rate: float) -> None:
        """One step down the gradient of some documents."""
        e, f = self.e, self.filters()
        bias, (out, out_bias) = self.dense[sum(WIDTHS) : -2], self.dense[-2:]
        filters, size = len(out) // len(WIDTHS), e.shape[1]
        seq, first = padded(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]))
        # where each filter peaks is found in single precision, what it gives there in double
        ahead, peaks = np.concatenate([seq, np.zeros(PAD, seq.dtype)]), self.peaks(seq, first)
        h = np.concatenate([sum(np.einsum("bfd,df->bf", e[ahead[peaks[k] + o]], fs[o]) for o in range(len(fs))) + bias[k] for k, fs in enumerate(f)], 1)
        on = np.maximum(h, 0)
        z = np.clip(on @ out + out_bias[0], -30, 30)
        gz = (1 / (1 + np.exp(-z)) - label) / len(parts)
        gh = gz[:, None] * out * (h > 0)
        grads, e_rows, e_grads = [], [], []
        for k, fs in enumerate(f):
            g = gh[:, k * filters : (k + 1) * filters]
            for o, flt in enumerate(fs):
                at = ahead[peaks[k] + o]
                grads.append(np.einsum("bf,bfd->df", g, e[at]) + 1e-5 * flt)
                e_rows.append(at.ravel())
                e_grads.append((g[:, :, None] * flt.T[None]).reshape(-1, size))
        grads += [gh[:, k * filters : (k + 1) * filters].sum(0) for k in range(len(f))] + [on.T @ gz + 1e-4 * out, np.array([gz.sum()])]
        self.steps += 1
        for p, g, (m, v) in zip(self.dense, grads, self.moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
        er, eg = np.concatenate(e_rows), np.concatenate(e_grads)
        np.add.at(self.seen, er, (eg * eg).mean(1))
        np.add.at(e, er, -0.05 * eg / (np.sqrt(self.seen[er])[:, None] + 1e-6))
        e[0] = 0


def _epoch(rows: DataFrame, fit: Fit, batch: int, rate: float) -> None:
    """``fit`` becomes the mean of what the shards make of it, each by steps over all its documents.

    A row of the embedding moves by the mean of the shards that moved it, the dense parameters by the
    mean of all, weighted by documents. Shards are added up in their order, so runs agree. The driver
    gets one row for each block of the embedding.
    """
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(fit)
    size = fit.e.shape[1]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, docs, parts, labels, tokens = None, None, 0, [], [], 0

        def moved() -> pa.RecordBatch:
            start = sent.value
            at = np.flatnonzero((own.seen != start.seen) | (own.e != start.e).any(1))
            by, seen = (own.e[at] - start.e[at]).astype("<f2"), (own.seen[at] - start.seen[at]).astype("<f4")
            cuts = np.searchsorted(at, np.arange(0, len(start.e) + BLOCK, BLOCK))
            out = [{"block": -1, "shard": shard, "n": docs, "steps": own.steps, "at": b"", "data": own.flat().astype("<f8").tobytes()}]
            out += [{"block": i, "shard": shard, "n": docs, "steps": own.steps, "at": (at[a:b] - i * BLOCK).astype("<i4").tobytes(), "data": by[a:b].tobytes() + seen[a:b].tobytes()} for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            return pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("steps", pa.int64()), ("at", pa.binary()), ("data", pa.binary())]))

        for some in batches:
            for s, label, data in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2)):
                part = sent.value.row[_rows_in(data)]
                if parts and (s != shard or len(parts) == batch or tokens + len(part) > 4 * RUN):
                    own.step(parts, np.array(labels, float), rate)
                    parts, labels, tokens = [], [], 0
                if s != shard:
                    if own:
                        yield moved()
                    own, shard, docs = sent.value.copy(), s, 0
                parts.append(part)
                labels.append(label)
                tokens, docs = tokens + len(part), docs + 1
        if own:
            own.step(parts, np.array(labels, float), rate)
            yield moved()

    def mean(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("shard", "ascending"), ("n", "ascending")])
        block, n = key[0].as_py(), table.column("n").to_numpy()
        if block < 0:
            lines = (np.frombuffer(x.as_buffer(), "<f8") * k for x, k in zip(table.column("data"), n))
            at, data = b"", (sum(lines) / n.sum()).tobytes()
        else:
            total, times = np.zeros((BLOCK, size + 1)), np.zeros(BLOCK)
            for x, y in zip(table.column("at"), table.column("data")):
                i = np.frombuffer(x.as_buffer(), "<i4")
                total[i, :size] += np.frombuffer(y.as_buffer(), "<f2", len(i) * size).reshape(len(i), size)
                total[i, size] += np.frombuffer(y.as_buffer(), "<f4", len(i), len(i) * size * 2)
                times[i] += 1
            i = np.flatnonzero(times)
            at, data = i.astype("<i4").tobytes(), (total[i] / times[i][:, None]).astype("<f4").tobytes()
        steps = int(table.column("steps").to_numpy().max())
        return pa.table({"block": pa.array([block], pa.int32()), "steps": pa.array([steps], pa.int64()), "at": pa.array([at], pa.binary()), "data": pa.array([data], pa.binary())})

    made = rows.select("shard", "label", "rows").mapInArrow(learn, "block int, shard int, n long, steps long, at binary, data binary")
    found = made.groupBy("block").applyInArrow(mean, "block int, steps long, at binary, data binary").toArrow()
    # in place, as the driver needs one of them alone
    for block, steps, at, data in zip(found["block"].to_pylist(), found["steps"].to_pylist(), found["at"], found["data"]):
        if block < 0:
            fit.unflatten(np.frombuffer(data.as_buffer(), "<f8"))
            fit.steps = steps
        else:
            i = np.frombuffer(at.as_buffer(), "<i4") + block * BLOCK
            by = np.frombuffer(data.as_buffer(), "<f4").reshape(len(i), size + 1)
            fit.e[i] += by[:, :-1]
            fit.seen[i] += by[:, -1]
    sent.destroy()


def train(texts: DataFrame, marks: DataFrame, size: int = 16, filters: int = 12, epochs: int = 6, bits: int = 18, min_docs: int = 3, batch: int = 64, seed: int = 7) -> ConvModel | None:
    """Fit the classifier to all ``doc_id, text`` rows that ``doc_id, label`` rows name; ``None`` where one of the labels is missing.

    Words are counted and looked up in Spark. Documents are dealt to shards by their id, of about
    :data:`EACH` documents, or more of them where that made over :data:`SHARDS`. In each epoch every shard
    goes on from the model so far over all its documents, in tasks, and the model becomes the mean of
    what they made of it. Each word's first coordinate starts at its log-odds among the training
    documents and the rest at small random numbers; all are trained. A fifth of the documents is kept
    from the fit and sets each language's threshold where the F1 measure is best; a language with few
    labels 1 takes the threshold of all.
    """
    marked = marks.agg(F.count("*").alias("n"), F.count_distinct("label").alias("k")).first()
    if marked["k"] < 2:
        return None
    row, tag, rank = _vocabulary(texts, bits, min_docs)
    model = ConvModel(row, tag, *[None] * 4, 0.0, None, np.zeros(len(LANGUAGES) + 1))
    every = _as_rows(texts, marks, model, shards_of(marked["n"]))
    counts = {(r["later"], r["label"]): r["n"] for r in every.groupBy("later", "label").agg(F.count("*").alias("n")).collect()}
    if len({label for _, label in counts}) < 2:
        return None
    both = (False, 0) in counts and (False, 1) in counts
    rows = every.where("not later") if both else every
    held = every.where("later") if both and any(later for later, _ in counts) else every
    ones, zeros = (sum(n for (x, label), n in counts.items() if label == want and not (x and both)) for want in (1, 0))
    of, odds = _odds(rows, rank, ones, zeros, min_docs)
    model.row = of[row]
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.05, (len(odds), size))
    e[:, 0] = np.clip(odds, -3, 3) / 2
    e[0] = 0
    spoken = np.full(len(odds), len(LANGUAGES), np.int64)
    f = [[rng.normal(0, 0.1, (size, filters)) for _ in range(k)] for k in WIDTHS]
    for fs in f:
        fs[0][0, : filters // 2] += 1
    bias = [np.zeros(filters) for _ in WIDTHS]
    out, out_bias = rng.normal(0, 0.1, len(WIDTHS) * filters), np.array([np.log(ones / zeros)])
    for at in range(len(WIDTHS)):
        out[at * filters : at * filters + filters // 2] += 0.2
    model.language = spoken
    for i, words in enumerate(LANGUAGES.values()):
        some = model.rows_of(words_of([words], ALNUM).hash)
        spoken[some[some > 0]] = i
    dense = [x for fs in f for x in fs] + bias + [out, out_bias]
    fit = Fit(of, e, np.zeros(len(e)), dense, [(np.zeros_like(x), np.zeros_like(x)) for x in dense], 0)
    for epoch in range(epochs):
        _epoch(rows, fit, batch, 0.01 * (1 - epoch / epochs))
    model.embedding, model.filters, model.bias = fit.e.astype(np.float32), fit.filters(), fit.dense[sum(WIDTHS) : -2]
    model.out, model.out_bias = fit.dense[-2], float(fit.dense[-1][0])
    found = best_thresholds(_rated(held, model, of))
    common, _ = found.get(len(LANGUAGES) + 1, (0.0, 0))
    model.thresholds[:] = common
    for i in range(len(LANGUAGES)):
        if found.get(i, (0.0, 0))[1] >= 15:
            model.thresholds[i] = found[i][0]
    discard(every)
    return model


def _rated(rows: DataFrame, model: ConvModel, of: np.ndarray) -> DataFrame:
    """``kind, z, n, ones``: for each language, and for all together under one number more, how many documents have an output ``z``, and how many of them label 1; written down."""
    sent = rows.sparkSession.sparkContext.broadcast((model, of))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, of = sent.value
        for some in batches:
            parts, labels = [of[_rows_in(x)] for x in some.column(1)], some.column(0)
            a = 0
            while a < len(parts):
                b, tokens = a + 1, len(parts[a])
                while b < len(parts) and tokens + len(parts[b]) <= 4 * RUN:
                    tokens, b = tokens + len(parts[b]), b + 1
                z, kind = model.outputs(*padded(np.concatenate(parts[a:b]), np.concatenate([[0], np.cumsum([len(x) for x in parts[a:b]])])))
                yield pa.RecordBatch.from_arrays([labels.slice(a, b - a), pa.array(z, pa.float64()), pa.array(kind, pa.int32())], ["label", "z", "kind"])
                a = b

    rated = rows.select(F.col("label"), "rows").mapInArrow(rate, T.StructType([rows.schema["label"], T.StructField("z", T.DoubleType()), T.StructField("kind", T.IntegerType())]))
    each = rated.select(F.explode(F.array("kind", F.lit(len(LANGUAGES) + 1))).alias("kind"), "z", "label")
    made = materialize(each.groupBy("kind", "z").agg(F.count("*").alias("n"), F.sum("label").alias("ones")), "rated")
    sent.destroy()
    return made


def best_thresholds(rated: DataFrame) -> dict[int, tuple[float, int]]:
    """For each ``kind`` of ``kind, z, n, ones`` rows the cut between two values of ``z`` with the best F1 measure, the lowest of equals, and its labels 1.

    Rows are added up by ranges of ``z``, so no task sees them all; 0 is the cut where no label is 1.
    """
    parts = int(rated.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rated.repartitionByRange(parts, "kind", F.desc("z")).withColumn("part", F.spark_partition_id()), "ranges")
    # one row for each range and kind
    before = Window.partitionBy("kind").orderBy("part")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("kind", "part").agg(F.sum("n").alias("k"), F.sum("ones").alias("hits"), F.max("z").alias("head"))
    bases = sums.select("kind", "part", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("k"), F.coalesce(F.sum("hits").over(earlier), F.lit(0)).alias("hits"), F.lead("head").over(before).alias("next"), F.sum("hits").over(Window.partitionBy("kind")).alias("total"))
    within = Window.partitionBy("kind", "part").orderBy(F.desc("z"))
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    cuts = dealt.withColumn("upto", F.sum("n").over(upto)).withColumn("got", F.sum("ones").over(upto)).withColumn("below", F.lead("z").over(within)).join(F.broadcast(bases), ["kind", "part"])
    got = F.col("got") + F.col("hits")
    f1 = F.round(2 * got / (F.col("upto") + F.col("k") + F.col("total")), 12)
    cut = (F.col("z") + F.coalesce("below", "next", F.col("z") - 2)) / 2
    found = cuts.where("total > 0").groupBy("kind").agg(F.max_by(cut, F.struct(f1, got)).alias("cut"), F.first("total").alias("total"))
    return {r["kind"]: (float(r["cut"]), int(r["total"])) for r in found.collect()}


def fit(docs: DataFrame, labels: DataFrame, learn, max_rows: int | None = None, max_bytes: int | None = None, label_col: str = "toxic", **options) -> ConvModel | None:
    """A model of all labelled documents; of at most ``max_rows`` and ``max_bytes`` of their text where one is given.

    Documents that carry several labels count as 1 if any label is; rows that share an id all take part.
    ``None`` where documents with a text bear one label or none; an error where only a sample does.
    """
    marks = marked_rows(labels, label_col, learn)
    texts = docs.where("text is not null").select("doc_id", "text")
    if max_rows is None and max_bytes is None:
        return train(texts.where(learn), materialize(marks, "marks"), **options)
    most = (1 << 31) - 1 if max_rows is None else max_rows
    sample = materialize(labelled_sample(docs, labels, label_col, learn, most, max_bytes), "labelled")
    model = train(sample, sample.select("doc_id", "label"), **options)
    if model is None and marks.join(texts.select("doc_id"), "doc_id", "left_semi").select("label").distinct().count() > 1:
        raise ValueError(f"the sample of {most} rows and {max_bytes} bytes lacks a label that documents have")
    return model


def score(docs: DataFrame, model: ConvModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row by its whole text, in one narrow pass.

    Null and empty texts are scored as texts without words, texts of any length by all their windows,
    and of filters' equal values the first counts; repeated rows and null ids give a row each; other
    columns are not read, whatever their names; an empty table gives no rows. Without a model (no
    labels to learn from) all scores are 0.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            s = sent.value.scores(texts) if sent.value else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    schema = T.StructType([picked.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return picked.mapInArrow(rate, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: ConvModel | None, text_col: str = "text") -> DataFrame:
    """The rows that are scored below 0.5, with all their columns, whatever their names.

    Null and empty texts are judged as texts without words, texts of any length whole, repeated rows
    alike; without a model, and of an empty table, all rows stay.
    """
    from photolake.llm.suffix_match import kept_rows

    sent = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, text_col, lambda: lambda texts: sent.value.scores(texts) < 0.5 if sent.value else np.ones(len(texts), bool))


def learned_rows():
    """Rows that the fold leaves to learn from."""
    return fold("doc_id") % 5 != 0


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from labelled rows outside the fold."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), learned_rows())
    return score(docs, model).select("doc_id", (~learned_rows()).alias("held_out"), "score", "predicted")
