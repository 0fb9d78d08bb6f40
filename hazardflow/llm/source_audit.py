"""Divergence of the sources of a language by their term frequencies, pair by pair.

Terms are runs of ASCII letters and characters beyond ASCII, with A-Z lower-cased. A language keeps
the terms of at least MIN_DOCS of its documents. A group (language and source) gives each kept term
p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), N the group's count of kept terms and V their number;
two shares p and q lie floor((p - q)^2 / (p + q)) apart. All arithmetic is on whole numbers: the
quotient is taken three digits at a time, so counts up to 9e15 are exact.

For a pair of groups only terms that one of them has need a look. Every group holds its (term
number, count) rows sorted, and a task takes the two arrays of an unordered pair: a galloping
intersection finds the terms of both, which are priced with both counts, the terms of one side with
that count and 0, and the terms of neither are all alike and priced once. The distance is the same
both ways, so each pair is priced once and listed for both groups.

Scale: terms are counted per batch and merged per task before the shuffle, so a hot source or term is
a row per task. The terms of a language are dealt into blocks of about BLOCK terms by their hash, and
a task holds one block of two groups: no array grows with the vocabulary. Block sums are added per
pair. The pairs themselves are the result's size. The ten best terms of a group are kept by a rank
limit that works before the shuffle. Sizes of groups and languages reach the rows by broadcast up to a
checked size, by salted keys beyond it, so a hot language is never one task.

Edge cases: null text, language and source are empty; a group without terms (or without kept ones)
still meets every other source of its language; a language without kept terms gives distance 0;
texts are read whole; repeated rows count each; an empty table gives no rows; only text, lang and
source are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardflow.llm.common import settle, sliced
from hazardflow.operators.lookup import attach, attach_written
from hazardflow.session import written

MIN_DOCS = 10
SCALE_DIGITS = 9
TOP = 10
BLOCK = 1 << 14
GATHER = 8 << 20
STRIDE = 64
#: What each byte of a text becomes: letters lower-case, bytes beyond ASCII as they are, others a space.
FOLDED = np.array([b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms, text after text, and the text each belongs to; texts has no nulls."""
    texts = pa.concat_arrays([texts.cast(pa.string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    folded = FOLDED[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(folded))
    lists = pc.ascii_split_whitespace(plain)
    terms, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(terms), 0)
    return terms.filter(full), owner[full.to_numpy(zero_copy_only=False)].astype(np.int64)


def _counted(table: pa.Table) -> pa.RecordBatch:
    """lang, source, term, n, docs of some rows of lang, source, text; a null term marks a group that occurs."""
    lang, source, text = (pc.fill_null(table.column(k).combine_chunks().cast(pa.string()), "") for k in ("lang", "source", "text"))
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    own = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    terms, owner = terms_of(text)
    coded = terms.dictionary_encode()
    code, size = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    per_doc, times = np.unique(owner * size + code, return_counts=True)
    key = own[per_doc // size] * size + per_doc % size
    keys, at = np.unique(key, return_inverse=True)
    counts, docs = np.bincount(at, times, len(keys)).astype(np.int64), np.bincount(at, minlength=len(keys))
    seen = np.unique(own)
    group = np.concatenate([keys // size, seen])
    term = pa.concat_arrays([coded.dictionary.take(pa.array(keys % size)), pa.nulls(len(seen), pa.string())])
    zeros = np.zeros(len(seen), np.int64)
    width = max(1, len(sources.dictionary))
    columns = [
        langs.dictionary.take(pa.array(group // width)),
        sources.dictionary.take(pa.array(group % width)),
        term,
        pa.array(np.concatenate([counts, zeros])),
        pa.array(np.concatenate([docs, zeros])),
    ]
    return pa.record_batch(columns, ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it); one null term per group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in sliced(batches, GATHER):
            held.append(batch)
            size += batch.nbytes
            if size >= GATHER:
                yield _counted(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield _counted(pa.Table.from_batches(held))
        settle()

    each = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share_sql(count: str, whole: str) -> str:
    """SQL of the share of a count; whole is N + 2 V."""
    return f"1 + cast(cast({count} + 2 as decimal(20, 0)) * {10**SCALE_DIGITS} div cast({whole} as decimal(20, 0)) as bigint)"


def shares(counts: np.ndarray, whole: int) -> np.ndarray:
    """The shares of many counts, three digits of the quotient at a time."""
    if whole >= 1 << 53:
        raise ValueError("too many terms for exact shares")
    found, rest = np.divmod(counts + 2, whole)
    for _ in range(SCALE_DIGITS // 3):
        digits, rest = np.divmod(rest * 1000, whole)
        found = found * 1000 + digits
    return found + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def galloped(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Places of short's values in long (both sorted and distinct), -1 where absent.

    For every STRIDE values the end of the search doubles its distance from where the last one stopped.
    """
    found = np.full(len(short), -1, np.int64)
    low, size = 0, len(long)
    for start in range(0, len(short), STRIDE):
        some = short[start : start + STRIDE]
        step, high = STRIDE, low
        while high < size and long[high] < some[-1]:
            high, step = high + step, 2 * step
        window = long[low : high + 1]
        at = np.searchsorted(window, some)
        inside = at < len(window)
        hit = np.flatnonzero(inside)[window[at[inside]] == some[inside]]
        found[start + hit] = low + at[hit]
        low = low + int(at[-1])
        if low >= size:
            break
    return found


def packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted ids as gaps and their counts, both in the narrowest whole numbers that hold them."""
    parts = []
    for values in (np.diff(ids, prepend=0), counts):
        kind = np.min_scalar_type(int(values.max()))
        parts += [kind.str[1:].encode(), values.astype(kind).tobytes()]
    return len(ids).to_bytes(4, "little") + b"".join(parts)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, at, out = int.from_bytes(data[:4], "little"), 4, []
    for _ in range(2):
        kind = np.dtype("<" + data[at : at + 2].decode())
        out.append(np.frombuffer(data, kind, n, at + 2).astype(np.int64))
        at += 2 + n * kind.itemsize
    return np.cumsum(out[0]), out[1]


def priced(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], wholes: tuple[int, int]) -> tuple[int, int]:
    """How many terms either side has, and what they are apart in all; zero counts stand for absent terms."""
    if len(one[0]) > len(other[0]):
        one, other, wholes = other, one, wholes[::-1]
    at = galloped(one[0], other[0])
    p, q = shares(one[1], wholes[0]), shares(other[1], wholes[1])
    none = shares(np.zeros(1, np.int64), wholes[0])[0], shares(np.zeros(1, np.int64), wholes[1])[0]
    both = at >= 0
    lone = np.ones(len(q), bool)
    lone[at[both]] = False
    value = apart(p[both], q[at[both]]).sum() + apart(p[~both], none[1]).sum() + apart(q[lone], none[0]).sum()
    return len(p) + int(lone.sum()), int(value)


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS, block: int = BLOCK) -> DataFrame:
    """lang, term, total, kept (V of the language), lang_n, block and id (place in its block), written."""
    known = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    known = written(known.filter(F.col("docs") >= min_docs).drop("docs"), "audit-terms")
    tongues = known.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_n"))
    placed = attach(known, tongues, ["lang"]).withColumn("block", F.expr(f"pmod(xxhash64(term), cast(ceil(kept / {block}) as bigint))"))
    number = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term"))
    return written(placed.withColumn("id", number), "audit-kept")


class Audit:
    """The tables of one audit: groups, and their kept terms with counts."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, block: int = BLOCK):
        counts = written(term_counts(docs), "audit-counts")
        kept = kept_terms(counts, min_docs, block)
        tongues = kept.groupBy("lang").agg(F.max("kept").alias("kept"), F.max("lang_n").alias("lang_n"))
        own = counts.filter("term is not null").select("lang", "source", "term", "n")
        self.terms = written(own.join(kept.select("lang", "term", "total", "block", "id"), ["lang", "term"]), "audit-rows")
        sizes = self.terms.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
        groups = counts.filter("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left")
        groups = groups.join(tongues, "lang", "left").na.fill(0, ["group_n", "kept", "lang_n"])
        #: lang, source, kept (V), whole and lang_whole (N + 2 V of the group and of its language)
        self.groups = written(
            groups.select(
                "lang",
                "source",
                "kept",
                (F.col("group_n") + 2 * F.col("kept")).alias("whole"),
                (F.col("lang_n") + 2 * F.col("kept")).alias("lang_whole"),
            ),
            "audit-groups",
        )

    def arrays(self) -> DataFrame:
        """lang, source, block and the sorted term numbers and counts of the group in that block."""
        rows = self.terms.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("rows"))

        @F.arrow_udf("binary")
        def pack(rows: pa.Array) -> pa.Array:
            out = []
            for i in range(len(rows)):
                part = rows[i].values
                out.append(packed(part.field("id").to_numpy().astype(np.int64), part.field("n").to_numpy()))
            return pa.array(out, pa.binary())

        return written(rows.select("lang", "source", "block", pack("rows").alias("rows")), "audit-arrays")

    def pairs(self, salts: int = 16) -> DataFrame:
        """Every unordered pair of groups of a language, once; a hot language is dealt over `salts` keys."""
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")
        one = self.groups.select("lang", "kept", F.col("source").alias("first"), F.col("whole").alias("first_whole"), F.pmod(F.xxhash64("source"), F.lit(salts)).alias("salt"))
        two = self.groups.select("lang", F.col("source").alias("second"), F.col("whole").alias("second_whole"), every)
        return written(one.join(two, ["lang", "salt"]).filter("first < second").drop("salt"), "audit-pairs")

    def distances(self) -> DataFrame:
        """lang, first, second and value: how far apart the two groups are over all kept terms."""
        arrays, pairs = self.arrays(), self.pairs()
        keys = ["lang", "first", "second", "block"]
        left = arrays.withColumnRenamed("source", "first").join(pairs, ["lang", "first"])
        right = arrays.withColumnRenamed("source", "second").join(pairs, ["lang", "second"])
        columns = [*keys, "first_whole", "second_whole", "rows"]
        empty = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def price(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
            some = one if one.num_rows else two
            wholes = some["first_whole"][0].as_py(), some["second_whole"][0].as_py()
            sides = [unpacked(t["rows"][0].as_py()) if t.num_rows else empty for t in (one, two)]
            terms, value = priced(*sides, wholes)
            names = [k.as_py() for k in key[:3]]
            return pa.table({"lang": [names[0]], "first": [names[1]], "second": [names[2]], "terms": [terms], "part": [value]})

        right = right.select(*[F.col(c).alias(c) for c in columns])  # columns of its own, told apart from the left ones
        grouped = left.select(*columns).groupBy(*keys).cogroup(right.groupBy(*keys))
        parts = grouped.applyInArrow(price, "lang string, first string, second string, terms long, part long")
        sums = parts.groupBy("lang", "first", "second").agg(F.sum("terms").alias("terms"), F.sum("part").alias("part"))
        rows = pairs.join(sums, ["lang", "first", "second"], "left").na.fill(0, ["terms", "part"])
        p, q = (share_sql("0", f"nullif({side}_whole, 0)") for side in ("first", "second"))
        rows = rows.withColumns({"p": F.expr(p), "q": F.expr(q)})
        absent = F.expr("(kept - terms) * ((p - q) * (p - q) div (p + q))")  # null without kept terms
        return rows.select("lang", "first", "second", (F.col("part") + F.coalesce(absent, F.lit(0))).alias("value"))

    def raised_terms(self, top: int = TOP) -> DataFrame:
        """lang, source, term, value and rank of the terms that a group has more of than its language, the `top` furthest."""
        rows = attach_written(self.terms, self.groups, ["lang", "source"])
        rows = rows.withColumns({"p": F.expr(share_sql("n", "whole")), "q": F.expr(share_sql("total", "lang_whole"))}).filter("p > q")
        value = F.expr("(p - q) * (p - q) div (p + q)").alias("value")
        best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
        ranked = rows.select("lang", "source", "term", value).withColumn("rank", F.row_number().over(best))
        return ranked.filter(F.col("rank") <= top)


def report(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank: all other sources of the language, and the ten furthest raised terms."""
    audit = Audit(docs)
    found = written(audit.distances(), "audit-distances")
    both = found.select("lang", F.col("first").alias("source"), F.col("second").alias("item"), "value")
    both = both.unionByName(found.select("lang", F.col("second").alias("source"), F.col("first").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = audit.raised_terms().select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(terms)


REPORT_SQL = """
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, row_number() OVER () AS doc
  FROM documents),
words AS (SELECT lang, source, doc, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
tongues AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT lang, source, coalesce(v, 0) AS v, CAST(coalesce(sum(counts.n), 0) + 2 * coalesce(any_value(v), 0) AS HUGEINT) AS whole,
    CAST(coalesce(any_value(tongues.n), 0) + 2 * coalesce(any_value(v), 0) AS HUGEINT) AS lang_whole
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN tongues USING (lang) LEFT JOIN counts USING (lang, source)
  GROUP BY lang, source, v),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000 * CAST(coalesce(c.n, 0) + 2 AS HUGEINT) // g.whole AS p, 1 + 1000000000 * CAST(k.total + 2 AS HUGEINT) // g.lang_whole AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM grid WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
WHERE part = 'pair' OR rank <= 10
"""
