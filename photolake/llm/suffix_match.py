"""Benchmark decontamination by suffix arrays over the training documents.

A task sorts all suffixes of its documents, shard by shard, and binary-searches every test suffix in
each of these arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photolake.llm.tables import table
from photolake.llm.words import ALNUM, Words, runs_of, words_of
from photolake.storage import materialize

#: Words of one suffix array; a longer document is an array of its own.
SHARD_WORDS = 1 << 19
#: Words of test items that are sent to every task at once; more go in several passes.
TEST_WORDS = 1 << 22


def ranked_suffixes(hashes: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Each suffix's place, from 1, in the order of its first ``depth`` words; equal ones share a place.

    ``end`` is where each suffix ends, and nothing comes before every word. Places by one word are
    doubled to two, four and so on, the last time with an overlap.
    """
    rank, k = np.unique(hashes, return_inverse=True)[1].astype(np.int64).ravel() + 1, 1
    at = np.arange(len(hashes))
    while k < depth:
        step = min(k, depth - k)
        to = np.minimum(at + step, max(len(hashes) - 1, 0))
        behind = np.where(at + step < end, rank[to], 0)
        rank = np.unique(rank * (len(hashes) + 1) + behind, return_inverse=True)[1].ravel() + 1
        k += step
        if len(rank) and rank.max() == len(rank):
            break
    return rank


BASE = np.uint64(0x9E3779B97F4A7C15)


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of :data:`BASE` from 0 to ``n`` at least; a task makes them once."""
    global _POWERS
    if len(_POWERS) <= n:
        _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, SHARD_WORDS), BASE, np.uint64))])
    return _POWERS


def prefixes(hashes: np.ndarray) -> np.ndarray:
    """Sums of the words' hashes, each times a power of :data:`BASE`, up to every place, modulo 2 ** 64."""
    return np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers(len(hashes))[: len(hashes)])])


class Tests(NamedTuple):
    """Words of the test items, and the suffixes that begin a window, ``window`` words or a whole shorter item.

    ``head`` has a place of each different window and ``length`` its words; the places of window i are
    ``place[first[i]:first[i + 1]]``, in the order of their whole suffixes. Item i has the words from
    ``begins[i]`` to ``begins[i + 1]``. ``owner`` has for each window the number of the set of items, in
    ``sets``, that it stands in. ``others`` are the words that share a hash with another one, by hash and
    bytes, with hashes of their own; ``known`` has a place of each hash.
    """

    words: Words
    items: list
    names: list
    begins: np.ndarray
    head: np.ndarray
    length: np.ndarray
    place: np.ndarray
    first: np.ndarray
    window: int
    owner: np.ndarray
    sets: list
    sums: np.ndarray
    others: dict
    known: tuple[np.ndarray, np.ndarray]


def _word(w: Words, i: int) -> bytes:
    return w.data[w.start[i] : w.end[i]]


def _told_apart(w: Words) -> tuple[Words, dict]:
    """``w`` with a hash of its own for each different word, and those that had to change."""
    first: dict[int, bytes] = {}
    others: dict[int, dict[bytes, int]] = {}
    hashes, changed = w.hash.tolist(), w.hash.copy()
    fresh = 1
    for i, h in enumerate(hashes):
        word = _word(w, i)
        if first.setdefault(h, word) != word:
            known = others.setdefault(h, {first[h]: h})
            if word not in known:
                while fresh in first or fresh in hashes:
                    fresh += 1
                known[word], fresh = fresh, fresh + 1
            changed[i] = known[word]
    return w._replace(hash=changed), others


def _heard(w: Words, others: dict) -> Words:
    """``w`` with the hashes that the tests' words have where several share one."""
    if not others or not len(w.hash):
        return w
    changed = w.hash.copy()
    for i in np.flatnonzero(np.isin(w.hash, np.array(list(others), np.uint64))).tolist():
        # a word that is none of the tests' gets a hash that they do not have
        changed[i] = others[int(w.hash[i])].get(_word(w, i), 0)
    return w._replace(hash=changed)


def test_suffixes(items: list[tuple[object, str | None]], window: int, names: list | None = None) -> Tests:
    """Every suffix of every item that begins a window, equal windows together."""
    w, others = _told_apart(words_of([text for _, text in items], ALNUM))
    n = np.diff(w.first)
    begin, end, at = np.repeat(w.first[:-1], n), np.repeat(w.first[1:], n), np.arange(len(w.hash))
    rank, full = (ranked_suffixes(w.hash, end, depth) for depth in (window, int(n.max(initial=0))))
    asked = np.flatnonzero((end - at >= window) | (at == begin))
    asked = asked[np.lexsort((asked, full[asked]))]
    first = np.flatnonzero(np.diff(rank[asked], prepend=-1))
    head = asked[first]
    of = np.searchsorted(w.first, asked, "right") - 1
    sets: dict[bytes, int] = {}
    owner = [sets.setdefault(np.unique(of[a:b]).tobytes(), len(sets)) for a, b in zip(first, np.append(first[1:], len(asked)))]
    at = np.unique(w.hash, return_index=True)
    return Tests(w, [k for k, _ in items], names or [None if k is None else str(k) for k, _ in items], w.first, head, np.minimum(end[head] - head, window), asked, np.append(first, len(asked)), window, np.array(owner, np.int64), [np.frombuffer(x, np.int64) for x in sets], prefixes(w.hash), others, at)


def _bound(hashes: np.ndarray, end: np.ndarray, order: np.ndarray, tests: Tests, right: bool) -> np.ndarray:
    """For all windows at once, the binary search of each in the suffix array ``order``."""
    low, high = np.zeros(len(tests.head), np.int64), np.full(len(tests.head), len(order), np.int64)
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) // 2
        suffix = order[mid]
        ahead = np.full(len(open_), right)
        alike = np.arange(len(open_))
        for d in range(tests.window):
            alike = alike[d < tests.length[open_[alike]]]
            if not len(alike):
                break
            to = suffix[alike] + d
            theirs = np.where(to < end[suffix[alike]], hashes[np.minimum(to, len(hashes) - 1)], 0)
            ours = tests.words.hash[tests.head[open_[alike]] + d]
            differ = theirs != ours
            ahead[alike[differ]] = theirs[differ] < ours[differ]
            alike = alike[~differ]
        low[open_] = np.where(ahead, mid + 1, low[open_])
        high[open_] = np.where(ahead, high[open_], mid)
    return low


class Shard(NamedTuple):
    """Words of some documents, and where the document of each word begins and ends."""

    words: Words
    begin: np.ndarray
    end: np.ndarray
    sums: np.ndarray
    powers: np.ndarray


def _alike(s: Shard, p: np.ndarray, tests: Tests, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from the places ``p`` of a shard and ``q`` of the tests are the same, ``most`` at most, by sums of hashes."""
    n = np.zeros(len(p), np.int64)
    step = 1 << max(int(most.max(initial=0)).bit_length() - 1, 0)
    while step:
        to = n + step
        fits = np.flatnonzero(to <= most)
        a, b, k = p[fits], q[fits], to[fits]
        ours, theirs = s.sums[a + k] - s.sums[a], tests.sums[b + k] - tests.sums[b]
        same = ours * s.powers[b] == theirs * s.powers[a]
        n[fits[same]] = k[same]
        step >>= 1
    return n


def longest(s: Shard, p: np.ndarray, which: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For places ``p`` at which the windows ``which`` stand: the words of the longest match, the first test place that has it, and how many have it.

    The suffix of each place is searched among the test suffixes of its window, which stand in order; the
    longest match is with one of the two between which it belongs.
    """
    stops = tests.begins[np.searchsorted(tests.begins, tests.place, "right")] if len(tests.place) else tests.place

    def common(i: np.ndarray) -> np.ndarray:
        q = tests.place[i]
        return _alike(s, p, tests, q, np.minimum(s.end[p] - p, stops[i] - q))

    def bound(least: np.ndarray | None, right: bool) -> np.ndarray:
        """Where the suffix belongs, or where those begin or end that share its first ``least`` words."""
        low, high = tests.first[which].copy(), tests.first[which + 1].copy()
        while (low < high).any():
            mid = np.minimum((low + high) // 2, len(tests.place) - 1)
            n, q = common(mid), tests.place[mid]
            # the suffixes stand in the order of hashes, and one that ends comes first
            theirs, ours = tests.words.hash[np.minimum(q + n, len(tests.words.hash) - 1)], s.words.hash[np.minimum(p + n, len(s.words.hash) - 1)]
            ahead = (p + n < s.end[p]) & ((q + n >= stops[mid]) | (theirs < ours))
            if least is not None:
                ahead = np.where(n >= least, right, ahead)
            ahead &= low < high
            low, high = np.where(ahead, mid + 1, low), np.where(ahead | (low >= high), high, mid)
        return low

    at = bound(None, False)
    before, behind = np.maximum(at - 1, tests.first[which]), np.minimum(at, tests.first[which + 1] - 1)
    words = np.maximum(common(before), common(behind))
    start, end = bound(words, False), bound(words, True)
    return words, tests.place[start], end - start


class Found(NamedTuple):
    n_words: np.ndarray
    n_hit: np.ndarray
    spans: list
    matches: list
    sets: list


def _occurrences(w: Words, end: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """``place, window``: where in a shard the windows stand, from its suffix array."""
    if not len(w.hash) or not len(tests.head):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(ranked_suffixes(w.hash, end, tests.window), kind="stable")
    low, high = (_bound(w.hash, end, order, tests, right) for right in (False, True))
    times = high - low
    which = np.repeat(np.arange(len(times)), times)
    return order[np.repeat(low, times) + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)], which


def search(texts: list[str | None], tests: Tests, told: bool = True) -> Iterator[tuple[int, int, Found]]:
    """Each shard of ``texts``: the rows it covers and what was found in them.

    A place has one window of full length at most, and one of each shorter length, however many items
    hold it, so all that is kept grows with the words alone. The words of every place that is hit are
    compared with those of the tests, so that no hash decides. Matches are left out unless ``told``.
    """
    for a, b in runs_of(texts, SHARD_WORDS * 6):
        w = _heard(words_of(texts[a:b], ALNUM), tests.others)
        n = np.diff(w.first)
        doc_of = np.repeat(np.arange(b - a), n)
        begin, end = np.repeat(w.first[:-1], n), np.repeat(w.first[1:], n)
        while True:
            place, which = _occurrences(w, end, tests)
            edges = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(edges, place, 1)
            np.add.at(edges, place + tests.length[which], -1)
            covered = np.cumsum(edges[:-1]) > 0
            hit = np.flatnonzero(covered)
            at = tests.known[1][np.searchsorted(tests.known[0], w.hash[hit])] if len(hit) else hit
            wrong = [i for i, j in zip(hit.tolist(), at.tolist()) if _word(w, i) != _word(tests.words, j)]
            if not wrong:
                break
            # words of the documents that share a hash with one of the tests are none of theirs
            w.hash[wrong] = 0
        spans, matches, sets = [[] for _ in range(b - a)], [[] for _ in range(b - a)], [()] * (b - a)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            # spans of neighbouring documents may touch
            while s < e:
                d = int(doc_of[s])
                stop = min(e, int(w.first[d + 1]))
                spans[d].append({"start": s - int(w.first[d]), "end": stop - int(w.first[d])})
                s = stop
        if len(place):
            # a row for each document and set of items
            pairs = np.unique(doc_of[place] * len(tests.sets) + tests.owner[which])
            docs = pairs // len(tests.sets)
            starts = np.flatnonzero(np.diff(docs, prepend=-1))
            for x, y in zip(starts.tolist(), np.append(starts[1:], len(docs)).tolist()):
                sets[int(docs[x])] = tuple((pairs[x:y] % len(tests.sets)).tolist())
        if told and len(place):
            for p, words, q, k in zip(*(x.tolist() for x in _maximal(w, begin, end, place, which, tests))):
                d, i = int(doc_of[p]), int(np.searchsorted(tests.begins, q, "right") - 1)
                matches[d].append({"item_id": tests.items[i], "start": p - int(w.first[d]), "item_start": q - int(tests.begins[i]), "words": words, "places": k})
        yield a, b, Found(n, np.bincount(doc_of[covered], minlength=b - a), spans, matches, sets)


def _maximal(w: Words, begin: np.ndarray, end: np.ndarray, place: np.ndarray, which: np.ndarray, tests: Tests) -> tuple[np.ndarray, ...]:
    """``place, words, test place, places``: the longest match of each place that the one before does not hold, and shorter items."""
    size = max(len(w.hash), len(tests.words.hash)) + 1
    long = tests.length[which] == tests.window
    order = np.argsort(place[long], kind="stable")
    p, i = place[long][order], which[long][order]
    s = Shard(w, begin, end, prefixes(w.hash), powers(size))
    words, q, k = longest(s, p, i, tests)
    held = np.zeros(len(p), bool)
    held[1:] = (p[1:] == p[:-1] + 1) & (begin[p[1:]] == begin[p[:-1]]) & (words[:-1] == words[1:] + 1)
    p, words, q, k = p[~held], words[~held], q[~held], k[~held]
    short, of = place[~long], which[~long]
    times = np.diff(tests.first)[of]
    return np.concatenate([p, short]), np.concatenate([words, tests.length[of]]), np.concatenate([q, tests.head[of]]), np.concatenate([k, times])


def _passes(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> list[DataFrame]:
    """The test items in parts of about ``most`` words, by a hash of item and text, however many there are."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"), F.col(item_col).cast("string").alias("name")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))), F.lit(0))).first()[0]
    parts = max(1, -(-total // most))
    return [items if parts == 1 else items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(parts)) == i) for i in range(parts)]


def _collected(part: DataFrame, window: int) -> Tests:
    found = part.toArrow()
    return test_suffixes(list(zip(found["item_id"].to_pylist(), found["text"].to_pylist())), window, found["name"].to_pylist())


def item_names(tests: Tests, sets: tuple[int, ...]) -> list[str]:
    """The ids, as text, of all items in some sets, each once and in order; null ones have none."""
    if not sets:
        return []
    at = np.unique(np.concatenate([tests.sets[k] for k in sets]))
    return sorted({tests.names[i] for i in at.tolist()} - {None})


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, test_words: int = TEST_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Verbatim test passages in whole documents: ``doc_id, n_words, spans, matches, n_items, items_sha256``.

    ``spans`` are the covered words as ``start, end``, ``n_items`` the number of different items with a
    passage in the document, and ``items_sha256`` the digest of their ids, sorted as text and joined by
    commas. ``matches`` are the longest matches, ``item_id, start, item_start, words, places``: where one
    begins that the match of the place before does not hold, the first test place that has it and how
    many have it; a shorter item is a match of its own. Words are counted from 0. A window is ``window``
    words of an item, or all words of a shorter item that has any.

    Each task builds suffix arrays over shards of its own documents and searches every test suffix in
    them, so documents are not shuffled and a passage that many share is found in each where it is.
    What is kept grows with the words of the documents, also where they repeat one word or share a
    passage with many items: equal windows are one, and the items of a window are kept once for all.
    The test items are sent to the tasks while they hold about ``test_words`` at most; a larger set
    goes in parts, a pass each, which is written down before the next part is sent, and what they found
    is merged by document.

    Null texts have no words; a text of any length is searched whole; repeated documents get rows of
    their own; repeated items are one place each, and items with a null id hit words but are no item of
    a document; other columns are not read, whatever their names; empty tables give no rows, or rows
    without matches.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts = _passes(benchmark, item_col, item_text_col, test_words)
    listed = len(parts) > 1
    item_type = parts[0].schema["item_id"].dataType
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    match = T.StructType([T.StructField("item_id", item_type), *(T.StructField(c, T.LongType()) for c in ("start", "item_start", "words", "places"))])
    schema = T.StructType([picked.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("matches", T.ArrayType(match)), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("items", T.ArrayType(T.StringType()))])
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    keyed = picked.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    def one_pass(tests: Tests) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow_match = pa.list_(pa.struct([("item_id", to_arrow_type(item_type)), *((c, pa.int64()) for c in ("start", "item_start", "words", "places"))]))
        sent = docs.sparkSession.sparkContext.broadcast(tests)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            digests: dict[tuple, tuple[int, str]] = {}
            for batch in batches:
                for a, b, f in search(batch.column(1).to_pylist(), sent.value):
                    for sets in f.sets:
                        if sets not in digests:
                            names = item_names(sent.value, sets)
                            digests[sets] = len(names), hashlib.sha256(",".join(names).encode()).hexdigest()
                    told = [digests[x] for x in f.sets]
                    items = [item_names(sent.value, x) if listed else None for x in f.sets]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(f.n_words), pa.array(f.spans, arrow_span), pa.array(f.matches, arrow_match), pa.array([n for n, _ in told], pa.int64()), pa.array([x for _, x in told], pa.string()), pa.array(items, pa.list_(pa.string()))], schema.names)
                    if len(digests) > 1 << 14:
                        digests.clear()

        result = keyed.mapInArrow(scan, schema)
        if listed:
            result = materialize(result, "matches")
            sent.destroy()
        return result

    found = [one_pass(_collected(p, window)) for p in parts]
    if not listed:
        return found[0].drop("text_hash", "items")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    # each pass has seen each row once; equal rows fall together and are told apart again by their number
    joined = lambda c: F.flatten(F.collect_list(c))
    together = every.groupBy("doc_id", "text_hash", "n_words").agg((F.count("*") / len(found)).cast("int").alias("n"), F.array_sort(F.array_distinct(joined("spans"))).alias("raw"), F.array_distinct(joined("matches")).alias("matches"), F.array_sort(F.array_distinct(joined("items"))).alias("items"))
    merged = F.expr("""aggregate(raw, cast(array() as array<struct<start:bigint,end:bigint>>), (acc, x) ->
        if(size(acc) > 0 and acc[size(acc) - 1].end >= x.start,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', acc[size(acc) - 1].start, 'end', greatest(acc[size(acc) - 1].end, x.end)))),
           concat(acc, array(x))))""")
    together = together.withColumns({"spans": merged, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.concat_ws(",", "items").cast("binary"), 256)})
    return together.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc_id", "n_words", "spans", "matches", "n_items", "items_sha256")


def kept_rows(docs: DataFrame, text_col: str, make: Callable[[], Callable[[list], np.ndarray]]) -> DataFrame:
    """Rows of ``docs`` whose text the predicate keeps, all columns as they are, without a shuffle."""
    position = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = make()
        for batch in batches:
            yield batch.filter(pa.array(wanted(batch.column(position).to_pylist()), pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, test_words: int = TEST_WORDS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents in which no window of any item occurs, with all their columns, whatever their names.

    Test items go to the tasks as in :func:`find_contamination`; if there are several passes, what one
    keeps is written down before the next. Null and empty texts have no words and stay, repeated rows
    are judged alike, a text of any length is searched whole, and empty tables take nothing away.
    """
    parts = _passes(benchmark, item_col, item_text_col, test_words)
    for part in parts:
        sent = docs.sparkSession.sparkContext.broadcast(_collected(part, window))

        def make(sent=sent):
            def wanted(texts: list) -> np.ndarray:
                return np.concatenate([np.zeros(0, bool), *(f.n_hit == 0 for _, _, f in search(texts, sent.value))])

            return wanted

        docs = kept_rows(docs, text_col, make)
        if len(parts) > 1:
            docs = materialize(docs, "clean")
            sent.destroy()
    return docs


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "n_items", "items_sha256", (n_hit > 0).alias("contaminated"))


ORACLE_SQL = r"""
with d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents
), b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), starts as (
  select item_id, w, least(len(w), 10) as n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from b where len(w) > 0
), windows as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as words from starts
), places as (
  select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from windows) where len(w) >= n
), hits as (
  select p.doc_id, p.i, p.n, windows.item_id from (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as words from places) p join windows using (n, words)
), covered as (
  select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + n)) as place from (select distinct doc_id, i, n from hits)) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from hits where item_id is not null) group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
"""
