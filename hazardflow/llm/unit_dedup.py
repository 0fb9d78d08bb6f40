"""Removal of repeated lines, paragraphs or sentences of lines by their digests.

A passage that starts inside a line is no repeated line, so a line can also be cut at its sentence ends
(SENTENCE): a unit then ends at a line break, or at `.`, `!` or `?` before a space, a line break or the
end, and holds what ends it. Units with fewer words than `least` always stay, as short lines and
sentences repeat by chance.

Units are normalised (A-Z lower-cased, ASCII white space collapsed), and the MD5 digests of all
units are grouped over the corpus. The occurrence of the smallest rank (document, then place) stays,
all others go; spans are character offsets into the original text, so kept and removed units can be
found there.

Scale: only digests and offsets are shuffled, never text; the first occurrence is a minimum merged
per task, and only digests that occur more than once are joined back; those met more than HOT times reach
their rows by broadcast up to a checked size, by salted keys beyond it, so no digest is one task.

Edge cases: null and empty texts have one empty unit (sentences: none); empty units always stay; a very
long text is cut as a whole, in its own task; extra columns do not matter, as only doc_id and text are read; rows of one id and
one text are one document, and all its rows lose the same units; a null id ranks after all others;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardflow.operators.lookup import attach_written
from hazardflow.session import written

HOT = 1000
LINE = "\n"
PARAGRAPH = "\n\n"
#: A sentence of a line with its end; a pattern, so that SQL cuts alike.
SENTENCE = r"(?:[^\n.!?]+|[.!?]+[^ \n.!?])+[.!?]*[ \n]?|[.!?]+[ \n]?|\n"
LEAST = 8
UNIT = "array<struct<start: bigint, stop: bigint, digest: binary>>"


def pieces(text: str, between: str) -> Iterator[tuple[int, str]]:
    """Start (characters) and content of each unit."""
    if between == SENTENCE:
        for found in re.finditer(SENTENCE, text):
            yield found.start(), found.group()
        return
    at = 0
    for unit in text.split(between):
        yield at, unit
        at += len(unit) + len(between)


def units_column(text: str, between: str, least: int) -> Column:
    """Start, stop (characters) and digest of each unit; the digest is null for units of fewer words than `least`, and empty ones."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("digest", pa.binary())]))

    def unit(at: int, content: str) -> dict:
        words = content.encode().lower().split()
        digest = hashlib.md5(b" ".join(words)).digest() if len(words) >= max(1, least) else None
        return {"start": at, "stop": at + len(content), "digest": digest}

    @F.arrow_udf(UNIT)
    def units(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([[unit(*found) for found in pieces(value or "", between)] for value in texts.to_pylist()], kind)

    return units(text)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64("text", F.lit(1))})


def removed_units(docs: DataFrame, between: str = LINE, least: int = 1) -> DataFrame:
    """doc_id, k1, k2 (the text's hashes), n_units, removed (start and stop of each unit that goes), per document."""
    found = written(_keyed(docs).select("doc_id", "k1", "k2", units_column("text", between, least).alias("units")), "units")
    who = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2", "place").alias("who")
    long = found.select("doc_id", "k1", "k2", F.posexplode("units").alias("place", "unit")).filter("unit.digest is not null")
    ranked = long.select("unit.digest", who, "unit.start", "unit.stop")
    first = ranked.groupBy("digest").agg(F.min("who").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = written(first, "first-units")
    hot = written(first.filter(F.col("n") > HOT).select("digest", F.col("first").alias("hot_first")), "hot-units")
    marked = attach_written(ranked, hot, ["digest"])
    common = marked.filter("hot_first is not null").withColumnRenamed("hot_first", "first")
    rest = marked.filter("hot_first is null").drop("hot_first").join(first.filter(F.col("n") <= HOT).drop("n"), "digest")
    gone = common.unionByName(rest).filter("first < who").select("who.doc_id", "who.k1", "who.k2", F.struct("start", "stop").alias("span")).distinct()
    spans = gone.groupBy("doc_id", "k1", "k2").agg(F.sort_array(F.collect_list("span")).alias("removed"))
    spans = spans.withColumnsRenamed({"doc_id": "id", "k1": "h1", "k2": "h2"})
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))
    every = found.select("doc_id", "k1", "k2", F.size("units").cast("long").alias("n_units"))
    joined = every.join(spans, same, "left")
    return joined.select("doc_id", "k1", "k2", "n_units", F.coalesce("removed", F.expr("array()").cast("array<struct<start: bigint, stop: bigint>>")).alias("removed"))


def cleaned_documents(docs: DataFrame, between: str = LINE, least: int = 1) -> DataFrame:
    """The rows with the removed units cut out (and the separator after each); all columns stay."""
    names = docs.columns
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), "doc_id", "text", F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"))
    gone = removed_units(docs, between, least).filter("size(removed) > 0").dropDuplicates(["doc_id", "k1", "k2"])
    gone = gone.withColumnsRenamed({"doc_id": "id", "k1": "h1", "k2": "h2"})
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))

    after = 0 if between == SENTENCE else len(between)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, removed: pa.Array) -> pa.Array:
        out = []
        for value, spans in zip(texts.to_pylist(), removed.to_pylist(), strict=True):
            if value is not None and spans:
                edges = [0, *[e for s in spans for e in (s["start"], min(len(value), s["stop"] + after))], len(value)]
                value = "".join([value[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
            out.append(value)
        return pa.array(out, pa.string())

    joined = rows.join(gone, same, "left").select("row", cut("text", "removed").alias("cut"))
    return joined.select(*[(F.col("cut") if n == "text" else F.col("row").getField(n)).alias(n) for n in names])


def report(docs: DataFrame, between: str = LINE, least: int = 1) -> DataFrame:
    """doc_id, n_units, n_removed, removed_chars and spans (start-stop, by comma) of every row."""
    rows = removed_units(docs, between, least)
    sizes = F.transform("removed", lambda s: s["stop"] - s["start"])
    texts = F.transform("removed", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string")))
    return rows.select(
        "doc_id",
        "n_units",
        F.size("removed").cast("long").alias("n_removed"),
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b).alias("removed_chars"),
        F.concat_ws(",", texts).alias("spans"),
    )


REPORT_SQL = f"""
WITH listed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SENTENCE}') AS units FROM documents),
long AS (SELECT doc_id, unnest(units) AS unit, generate_subscripts(units, 1) AS place FROM listed),
placed AS (
  SELECT doc_id, place, length(unit) AS size,
    sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY place) - length(unit) AS start,
    trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[ \\t\\r\\n\\x0B\\x0C]+', ' ', 'g'), ' ') AS plain
  FROM long),
ranked AS (
  SELECT *, CASE WHEN len(string_split(plain, ' ')) >= {LEAST} THEN row_number() OVER (PARTITION BY plain ORDER BY doc_id, place) ELSE 1 END AS turn
  FROM placed),
summed AS (
  SELECT doc_id, count(*) FILTER (turn > 1) AS n_removed,
    CAST(coalesce(sum(size) FILTER (turn > 1), 0) AS BIGINT) AS removed_chars,
    coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + size AS BIGINT), ',' ORDER BY place) FILTER (turn > 1), '') AS spans
  FROM ranked GROUP BY doc_id)
SELECT doc_id, CAST(len(units) AS BIGINT) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed_chars, 0) AS removed_chars,
  coalesce(spans, '') AS spans
FROM listed LEFT JOIN summed USING (doc_id)
"""
