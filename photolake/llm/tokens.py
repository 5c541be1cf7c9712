"""Tokenizer work: token counts, and flat binary files of token ids."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from photolake.llm.tables import table, unused
from photolake.storage import materialize, scratch_path

_TOKENIZERS: dict = {}
#: Most encoded pieces that one Python worker keeps.
MAX_PIECES = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _tokenizer(path: str):
    """The tokenizer of this Python worker, loaded once; the path must exist on every worker."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


#: Places where the byte-level pre-tokenizer always starts a new piece: white space behind anything else,
#: and a mark behind a letter. The marks that begin contractions and stand inside special tokens are not here.
_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r\f\v])|(?<=[^\W\d_])(?=[!\"#$%&()*+,\-./:;<=>?@\[\]^_`{}~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")


def split_safely(text: str, size: int) -> list[str]:
    """``text`` in parts of about ``size`` characters whose tokens are those of the whole text.

    Cuts are made where a new piece always starts, in any script: before white space, and before a mark
    behind a letter. A text without such a place (one run of digits, say) stays whole.
    """
    if len(text) <= size:
        return [text]
    parts, at = [], 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        parts.append(text[at : m.start()])
        at = m.start()
    parts.append(text[at:])
    return parts


def _batches(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of consecutive parts of at most ``most`` bytes together, one part at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 512, batch_bytes: int = 1 << 20, part_chars: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every text: ``doc_id, n_bytes, n_tokens, over_limit``.

    Arrow batches go to the encoder in runs balanced by bytes, texts beyond ``part_chars`` in parts
    cut at safe places, and only lengths come back. One narrow pass, no shuffle. Null texts count
    as empty (0 bytes, 0 tokens); repeated rows and null ids give a row each; an empty table gives
    no rows; other columns are not read, whatever their names.
    """
    path = tokenizer or default_tokenizer()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for batch in batches:
            n_bytes, n_tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            rows, parts, sizes = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for part in split_safely(text, part_chars) if text else ():
                    rows.append(i)
                    parts.append(part)
                    sizes.append(len(part) if part.isascii() else len(part.encode()))
            for a, b in _batches(sizes, batch_bytes):
                for i, found in zip(rows[a:b], t.encode_batch_fast(parts[a:b], add_special_tokens=False)):
                    n_tokens[i] += len(found)
            np.add.at(n_bytes, rows, sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens)], ["doc_id", "n_bytes", "n_tokens"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([picked.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return picked.mapInArrow(lengths, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"))


#: A space before more white space.
_SPACE_RUN = re.compile(r" (?=\s)")
#: Marks that are cut off the end of a word of letters; the one that begins contractions is not here.
_MARKS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~"


class PieceCache:
    """Ids of the pieces between spaces, as bytes, kept from text to text.

    A space before a character that is no white space always starts a new piece of the byte-level
    pre-tokenizer, and so do marks behind a letter, and a line end between anything else and a letter.
    New words of letters are encoded together in one text; a token that starts with a space, or is a
    line end, starts the next word.
    """

    def __init__(self, t, code: str) -> None:
        self.t, self.code, self.width = t, code, array(code).itemsize
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.starts = {" ": np.zeros(t.get_vocab_size(), bool), "\n": np.zeros(t.get_vocab_size(), bool)}
        for token, i in t.get_vocab().items():
            self.starts[" "][i] = token.startswith("\u0120")
            self.starts["\n"][i] = token == "\u010a"

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _add_words(self, words: list[str], before: str) -> None:
        """Words that stand behind ``before``, a space or a line end, which is a part of their ids."""
        for i in range(0, len(words), 2000):
            some = words[i : i + 2000]
            ids = np.array(self.t.encode_batch_fast([before + before.join(some)], add_special_tokens=False)[0].ids, np.int64)
            at = np.append(np.flatnonzero(self.starts[before][ids]), len(ids)) * self.width
            data, at = ids.astype(f"<u{self.width}").tobytes(), at.tolist()
            self.known.update(zip(some if before == " " else [before + x for x in some], [data[a:b] for a, b in zip(at, at[1:])]))

    def learn(self, pieces: set[str]) -> None:
        """Make sure that all ``pieces``, each behind a space, are known."""
        if len(self.known) > MAX_PIECES:
            self.known.clear()
            self.marks = {"": b""}
        known, words, tails, marks, joined, odd = self.known, set(), set(), set(), [], []
        for piece in pieces.difference(known):
            if piece.isalpha():
                words.add(piece)
                continue
            head, line, tail = piece.partition("\n")
            word = head.rstrip(_MARKS)
            if not word.isalpha() or line and not tail.isalpha():
                odd.append(piece)
                continue
            joined.append((piece, word, head[len(word) :], line + tail))
            words.add(word)
            marks.add(head[len(word) :])
            if line:
                tails.add(tail)
        self._add_words(list(words.difference(known)), " ")
        self._add_words([x for x in tails if "\n" + x not in known], "\n")
        new = list(marks.difference(self.marks))
        self.marks.update(zip(new, self._ids(new)))
        for piece, word, mark, tail in joined:
            known[piece] = known[word] + self.marks[mark] + (known[tail] if tail else b"")
        known.update(zip(odd, self._ids([" " + x for x in odd])))

    def encode(self, texts: list[str | None], end: bytes) -> list[bytes]:
        """Ids of each text with the end id; texts where white space or the end follows a space go whole."""
        split = [x.split(" ") if x and x[-1] != " " and not _SPACE_RUN.search(x) else None for x in texts]
        self.learn({x for p in split if p for x in p[1:]})
        whole = self._ids([p[0] if p else (x or "") for p, x in zip(split, texts)])
        get = self.known.__getitem__
        return [first + (b"".join(map(get, p[1:])) if p else b"") + end for first, p in zip(whole, split)]


_CACHES: dict = {}


def _cache(path: str, code: str) -> PieceCache:
    """The cache of this Python worker."""
    if (path, code) not in _CACHES:
        _CACHES[path, code] = PieceCache(_tokenizer(path), code)
    return _CACHES[path, code]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


#: What the files of a shard are called.
_NAMES = {"tokens": "bin", "offsets": "idx", "ids": "idx"}


class _Shard:
    """Files of one shard that are written as documents come, under names of the attempt, and moved into place at the end."""

    def __init__(self, root: str, name: str, attempt: str, plain: bool) -> None:
        self.root, self.name, self.attempt, self.plain = root, name, attempt, plain
        self.there, _ = _filesystem(root)
        self.out = {k: self.there.open_output_stream(f"{self._path(k)}.{attempt}") for k in _NAMES}
        self.n_docs = self.n_tokens = 0
        self.out["offsets"].write(np.zeros(1, "<i8").tobytes())

    def _path(self, kind: str) -> str:
        return _filesystem(f"{self.root}/{kind}-{self.name}.{_NAMES[kind]}")[1]

    def add(self, ids: list, found: list[bytes], width: int) -> None:
        ends = self.n_tokens + np.cumsum(np.fromiter((len(x) // width for x in found), np.int64, len(found)))
        self.out["tokens"].write(b"".join(found))
        self.out["offsets"].write(ends.astype("<i8").tobytes())
        if self.plain:
            # a number and a 0/1 mark for null
            self.out["ids"].write(np.array([(x or 0, x is None) for x in ids], "<i8").tobytes())
        else:
            self.out["ids"].write("".join(json.dumps(x) + "\n" for x in ids).encode())
        self.n_docs, self.n_tokens = self.n_docs + len(ids), int(ends[-1])

    def close(self) -> None:
        for kind, out in self.out.items():
            out.close()
            self.there.move(f"{self._path(kind)}.{self.attempt}", self._path(kind))


def _get(uri: str, dtype: str) -> np.ndarray:
    """The numbers of a file, memory-mapped where the file system is a mounted one."""
    there, path = _filesystem(uri)
    if there.type_name == "local":
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    with there.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", run_bytes: int = 1 << 20, shard_bytes: int = 1 << 30, order: tuple[str, ...] = ()) -> DataFrame:
    """Encode every text and write flat files of ids below ``folder`` in ascending id order, or in that of the columns ``order``.

    ``docs`` is dealt by ranges of id and text, so the shards of task k hold smaller ids than those of
    task k + 1, or the same where an id has many rows; with ``order`` by ranges of these columns. A task writes as documents come, and begins
    another shard behind ``shard_bytes`` of ids, so it never holds more than a run of them. A shard is

    * ``tokens-k.bin``: ids as little-endian unsigned integers, 16 bits wide where the vocabulary
      allows it, else 32;
    * ``offsets-k.idx``: 64-bit offsets into it, one more than documents;
    * ``ids-k.idx``: for each document its 64-bit id and a 64-bit 0/1 mark for null; ids that are no
      whole numbers are lines of JSON instead.

    Returns the manifest ``shard, piece, name, n_docs, n_tokens, token_base, doc_base``, written as a
    table too; the bases are prefix sums over the shards. Null and empty texts give just the end id; a
    text of any length is encoded whole. Null ids come first; rows that share an id, repeated ones too,
    follow by a hash of their text, null ones first. Other columns are not read, whatever their names. An empty table
    gives no shard.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = folder.rstrip("/")
    plain = isinstance(docs.schema[id_col].dataType, T.IntegralType)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        # the tokenizer is loaded by tasks alone, as it would stay in the driver's memory
        width = "<u2" if max(_tokenizer(path).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"
        code = "H" if width == "<u2" else "I"
        end = array(code, [end_id]).tobytes()
        cache, part, piece, shard, done = _cache(path, code), context.partitionId(), 0, None, []
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _batches([len(x or "") for x in texts], run_bytes):
                if shard is None:
                    shard = _Shard(root, f"{part:06d}-{piece:04d}", str(context.taskAttemptId()), plain)
                shard.add(ids[a:b], cache.encode(texts[a:b], end), len(end))
                if shard.n_tokens * len(end) >= shard_bytes:
                    done.append((piece, shard))
                    shard.close()
                    piece, shard = piece + 1, None
        if shard is not None:
            done.append((piece, shard))
            shard.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([part] * len(done), pa.int64()), "piece": pa.array([k for k, _ in done], pa.int64()), "name": pa.array([x.name for _, x in done], pa.string()), "n_docs": pa.array([x.n_docs for _, x in done], pa.int64()), "n_tokens": pa.array([x.n_tokens for _, x in done], pa.int64()), "width": pa.array([width] * len(done), pa.string())})

    _make_folder(spark, root)
    picked_columns = [F.col(id_col).cast("long" if plain else "string").alias("id"), F.col(text_col).alias("text"), F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col)).alias("text_hash")]
    by = [f"by_{i}" for i in range(len(order))] or ["id", "text_hash"]
    picked = docs.select(*picked_columns, *(F.col(c).alias(n) for c, n in zip(order, by)))
    dealt = picked.repartitionByRange(shards, *by).sortWithinPartitions(*by).select("id", "text")
    written = materialize(dealt.mapInArrow(write, "shard long, piece long, name string, n_docs long, n_tokens long, width string"), "shards")
    # one row for each shard
    before = Window.orderBy("shard", "piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = written.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("n_tokens", "token_base"), ("n_docs", "doc_base"))))
    bases.select(*(c for c in bases.columns if c != "width"), "width", F.lit(plain).alias("plain")).write.parquet(f"{root}/manifest")
    return spark.read.parquet(f"{root}/manifest")


def in_stored_order(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """``docs`` with columns that tell how its rows stand in the files it is read from, and the names of these.

    Files that a writer has numbered come by their number, then by name. A table that is not read from
    such files comes back as it is, without names.
    """
    part, file, row = unused(docs, "part", "file", "row")
    number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    try:
        return docs.select("*", number.alias(part), F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row)), (part, file, row)
    except AnalysisException:
        return docs, ()


def _make_folder(spark, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def read_token_files(manifest: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """Documents of written files: ``doc_id, start, n_tokens, ids_crc32``, in file order within a shard.

    Each shard's files are mapped by one task and read document by document. Null ids come back as
    null. ``id_type`` is ``string`` for ids that are no whole numbers. No shards give no rows.
    """
    root, kind = folder.rstrip("/"), pa.int64() if id_type == "long" else pa.string()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = _get(f"{root}/tokens-{row['name']}.bin", row["width"])
                offsets = _get(f"{root}/offsets-{row['name']}.idx", "<i8")
                if row["plain"]:
                    named = _get(f"{root}/ids-{row['name']}.idx", "<i8").reshape(-1, 2)
                    ids = lambda a, b, x=named: pa.array(np.array(x[a:b, 0]), mask=x[a:b, 1] == 1)
                else:
                    lines = bytes(_get(f"{root}/ids-{row['name']}.idx", "u1")).decode().split("\n")
                    ids = lambda a, b, x=lines: pa.array([json.loads(y) for y in x[a:b]], kind)
                for a in range(0, row["n_docs"], 10_000):
                    b = min(row["n_docs"], a + 10_000)
                    at = offsets[a : b + 1].tolist()
                    sums = [zlib.crc32(tokens[i:j].astype("<u4").tobytes()) for i, j in zip(at, at[1:])]
                    yield pa.RecordBatch.from_arrays([ids(a, b), pa.array(offsets[a:b] + row["token_base"]), pa.array(np.diff(offsets[a : b + 1])), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "piece")
    return spread.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    """Writes all documents as token files and reads the files back."""
    folder = scratch_path(spark, "tokens")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), folder), folder)
