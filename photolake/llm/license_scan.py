"""License scans by diagonal voting over rolling word k-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from photolake.llm.tables import table
from photolake.llm.words import ALNUM, mixed, runs_of, words_of
from photolake.storage import materialize

# Phrases and license texts and notices, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "Released under the MIT license"),
    ("mit", "Licensed under the MIT license"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
]
#: Words of a gram; no phrase has fewer.
GRAM = 3


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    out = hashes[: len(hashes) - k + 1].copy() if len(hashes) >= k else np.zeros(0, np.uint64)
    for i in range(1, k):
        out = mixed(out) + hashes[i : len(hashes) - k + 1 + i]
    return out


def _words(text: str) -> list[bytes]:
    w = words_of([text], ALNUM)
    return [w.data[a:b] for a, b in zip(w.start.tolist(), w.end.tolist())]


def template_grams(templates: list[tuple[str, str]], phrases: dict[str, str], k: int) -> tuple[list[tuple], dict[int, bytes]]:
    """``gram, template, label, is_phrase, place, grams`` of every place of every template, and each gram's words."""
    rows, texts = [], {}
    every = [(label, text, False) for label, text in templates] + [(label, text, True) for text, label in phrases.items()]
    for t, (label, text, phrase) in enumerate(every):
        grams, words = _grams(words_of([text], ALNUM).hash, k).view(np.int64).tolist(), _words(text)
        if not grams:
            raise ValueError(f"shorter than {k} words: {text}")
        for i, g in enumerate(grams):
            if texts.setdefault(g, b" ".join(words[i : i + k])) != b" ".join(words[i : i + k]):
                raise ValueError(f"two grams have one hash: {texts[g]!r}")
            rows.append((g, t, label, phrase, i, len(grams)))
    return rows, texts


def _scanned(docs: DataFrame, k: int, texts: dict[int, bytes]) -> DataFrame:
    """``doc_id, text_hash, n_words, grams`` of every row; ``grams`` are the hashes of its rolling k-grams in order.

    A gram whose hash is that of a template's gram, but whose words are others, gets 0.
    """
    known = np.array(sorted(texts), np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            for a, b in runs_of(rows):
                w = words_of(rows[a:b], ALNUM)
                n = np.diff(w.first)
                rolled = np.concatenate([_grams(w.hash, k), np.zeros(min(k - 1, len(w.hash)), np.uint64)]).view(np.int64)
                # a list column over the same numbers: each document's grams end k - 1 words before it does
                inside = np.ones(len(rolled), bool)
                for i in range(1, k):
                    inside[w.first[1:][n >= i] - i] = False
                at = np.minimum(np.searchsorted(known, rolled), len(known) - 1)
                for i in np.flatnonzero(inside & (known[at] == rolled)).tolist() if len(known) else ():
                    if b" ".join(w.data[w.start[j] : w.end[j]] for j in range(i, i + k)) != texts[int(rolled[i])]:
                        rolled[i] = 0
                ends = np.concatenate([[0], np.cumsum(np.maximum(n - k + 1, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(rolled[inside]))], schema.names)

    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(scan, schema)


def find_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, k: int = GRAM, drift: int = 3, coverage: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """License notices in whole documents.

    Every k-gram of every document is joined in Spark to the places where it stands in a template; its
    words are compared, not only their hashes. A pair of places votes for its diagonal, the difference
    of the two. Diagonals of a document and a template that lie within ``drift`` of the one before and
    overlap or touch are merged to a span, and a span is verified when the different template places
    it holds reach ``coverage`` of the template's grams. A phrase's place is a diagonal that holds all
    its grams, hence all its words in a row.

    Returns ``(documents, spans)``: documents as ``doc_id, text_hash, n_words``, a row for each row,
    and spans as ``doc_id, text_hash, label, is_phrase, first_word, last_word, coverage``, once for
    documents that are equal in id and text. Documents are read once; votes are written down. The
    templates are a parameter given by the caller and are joined as the small side; a document is only
    ever grouped with itself, by places that match, however long it is.

    Spans of equal coverage all come. Null and empty texts have no words; null ids are an id of their
    own; other columns are not read, whatever their names; an empty table gives none.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("text_hash"))
    rows, texts = template_grams(templates, phrases, k)
    known = spark.createDataFrame(rows, "gram long, template int, label string, is_phrase boolean, place int, grams int")
    # the null behind a document's grams joins with nothing and stays as the row of the document
    every = _scanned(picked, k, texts).select("doc_id", "text_hash", "n_words", F.posexplode(F.concat("grams", F.array(F.lit(None).cast("long")))).alias("at", "gram"))
    voted = materialize(every.join(F.broadcast(known), "gram", "left").where("gram is null or template is not null"), "votes")
    votes = voted.where("gram is not null").select("doc_id", "text_hash", "template", "label", "is_phrase", "grams", "at", "place").distinct()
    keys = ["doc_id", "text_hash", "template", "label", "is_phrase", "grams"]
    lines = votes.withColumn("diagonal", F.col("at") - F.col("place")).groupBy(*keys, "diagonal").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"), F.collect_set("place").alias("places"))
    exact = lines.where("is_phrase and n = grams").select("doc_id", "text_hash", "label", "is_phrase", F.col("diagonal").cast("long").alias("first_word"), (F.col("diagonal") + F.col("grams") + (k - 2)).cast("long").alias("last_word"), F.lit(1.0).alias("coverage"))
    order = Window.partitionBy(*keys).orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(order) > drift) | (F.col("low") > F.lag("high").over(order) + k + drift) | (F.col("high") + k + drift < F.lag("low").over(order))
    marked = lines.where("not is_phrase").withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("span", F.sum("fresh").over(order))
    spans = marked.groupBy(*keys, "span").agg(F.min("low").alias("low"), F.max("high").alias("high"), (F.size(F.array_distinct(F.flatten(F.collect_list("places")))) / F.first("grams")).alias("coverage"))
    near = spans.where(F.col("coverage") >= coverage).select("doc_id", "text_hash", "label", "is_phrase", F.col("low").cast("long").alias("first_word"), (F.col("high") + k - 1).cast("long").alias("last_word"), "coverage")
    return voted.where("gram is null").select("doc_id", "text_hash", "n_words"), exact.unionByName(near)


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    docs, spans = find_licenses(table(spark, sf_dir, "documents"))
    is_phrase = F.col("is_phrase")
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.count_if(is_phrase).alias("n_base"), F.min(F.when(is_phrase, F.col("first_word"))).alias("first_word"), F.max(F.when(is_phrase, F.col("first_word"))).alias("last_word"), labels(F.when(is_phrase, F.col("label"))).alias("base_labels"), labels("label").alias("labels"), F.max("coverage").alias("score"))
    both = docs.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    return both.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _known_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    every = [(label, text, False) for label, text in TEMPLATES] + [(label, text, True) for text, label in PHRASES.items()]
    return ", ".join(f"({i}, {quoted(label)}, {str(phrase).lower()}, {quoted(text)})" for i, (label, text, phrase) in enumerate(every))


ORACLE_SQL = rf"""
with d as (
  select row_number() over () as id, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents
), known as (
  select template, label, is_phrase, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from (values {_known_sql()}) t(template, label, is_phrase, text)
), kg as (
  select template, label, is_phrase, len(w) - 2 as grams, i - 1 as place, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as gram from (select *, unnest(range(1, len(w) - 1)) as i from known)
), dg as (
  select id, i - 1 as pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as gram from (select *, unnest(range(1, greatest(len(w) - 1, 1))) as i from d)
), votes as (
  select id, template, label, is_phrase, grams, pos, place, pos - place as diagonal from dg join kg using (gram)
), lines as (
  select id, template, label, is_phrase, grams, diagonal, count(*) as n, min(pos) as low, max(pos) as high from votes group by all
), marked as (
  select *, case when diagonal - lag(diagonal) over o > 3 or low > lag(high) over o + 6 or high + 6 < lag(low) over o or lag(low) over o is null then 1 else 0 end as fresh
  from lines where not is_phrase window o as (partition by id, template order by diagonal)
), numbered as (
  select *, sum(fresh) over (partition by id, template order by diagonal) as span from marked
), spans as (
  select n.id, n.label, count(distinct v.place) / any_value(n.grams)::double as coverage
  from numbered n join votes v on v.id = n.id and v.template = n.template and v.diagonal = n.diagonal group by n.id, n.template, n.label, n.span
), found as (
  select id, label, true as is_phrase, diagonal as first_word, 1.0::double as coverage from lines where is_phrase and n = grams
  union all select id, label, false, null, coverage from spans where coverage >= 0.6
), summed as (
  select id, count(*) filter (is_phrase) as n_base, min(first_word)::bigint as first_word, max(first_word)::bigint as last_word,
    coalesce(string_agg(distinct label, ',' order by label) filter (is_phrase), '') as base_labels, string_agg(distinct label, ',' order by label) as labels, max(coverage) as score
  from found group by id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from d left join summed using (id)
"""
