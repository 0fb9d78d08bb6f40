"""Quality rules with thresholds learned per language and source.

Every document has shares (symbols, upper case, repeated lines, repeated words) and a mean word
length. Their distributions are kept as mergeable quantile sketches: counts of logarithmic buckets
(relative error RATIO), so sketches of any two sets merge by adding counts, exactly and in any order.
The sketch of a group (language and source) merges into that of its language and of all documents.

Bounds come from the sketches alone. The middle of a group is its median, its width the distance from
its 10 % to its 90 % quantile, held between half and twice the width of its language, so that neither
a source full of junk nor one of equal texts sets its own scale; groups below MIN_DOCS take the next wider
sketch. A value is out when it lies more than SPREAD widths above the median (word length: also below).
A share of a short text is a count of few: the counted values may exceed what the bound expects of
a text of that size by DEVIATIONS standard deviations of a Poisson count of events, where one event
adds GRAIN to the count (a repeated window: two times three words). Up to half of a group may be junk, and up
to a tenth of its language. `rejections` counts what each bound rejects per group.

Scale: two scans; buckets are counted per task before they are shuffled, so a hot group is a few
hundred rows per task. The thresholds are written once and joined by group (null-safe).

Edge cases: null and empty texts have no words and fail the base rule; null language or source is a
group of its own; rows that repeat are judged each; an empty table gives no rows; columns of the
input that have the names of results do not matter, as only doc_id, text, lang and source are read;
very long texts are counted whole, in slices of an Arrow batch; a value equal to its bound is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardflow.llm.common import settle
from hazardflow.llm.text_metrics import base_metrics
from hazardflow.session import written

RATIO = 0.02
LOWEST = 1e-4
MIN_DOCS = 100
LOW, HIGH = 0.1, 0.9
SPREAD = 3.0
DEVIATIONS = 3.0
COUNTS = ["n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words"]
#: Part and whole of each value that counts events, and what one event adds to the part.
SHARES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
}
GRAIN = {"symbol_share": 1, "upper_share": 1, "dup_line_share": 1, "repeat_share": 6}
LENGTH = "word_length"
CONTRACT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def counts_column(text: str = "text") -> Column:
    """Struct of the counts of each text."""

    @F.arrow_udf(f"struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            step = max(1, len(texts) * (2 << 20) // max(texts.nbytes, 1))
            parts = [base_metrics(texts.slice(i, step)) for i in range(0, max(len(texts), 1), step)]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([p[c] for p in parts]), pa.int64()) for c in COUNTS], COUNTS)
        settle()

    return count(text)


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row."""
    return docs.select("doc_id", "lang", "source", counts_column().alias("found")).select("doc_id", "lang", "source", "found.*")


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def values() -> dict[str, Column]:
    return {**{k: _share(*parts) for k, parts in SHARES.items()}, LENGTH: _share("word_chars", "n_words")}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, name, bucket, n of the documents that pass the base rule."""
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in values().items()])
    long = rows.filter(~base_failed()).select("lang", "source", F.explode(pairs).alias("p"))
    bucket = F.when(F.col("p.value") < LOWEST, F.lit(-1)).otherwise(
        F.floor(F.log(F.col("p.value") / LOWEST) / math.log1p(RATIO)).cast("int")
    )
    return long.groupBy("lang", "source", F.col("p.name").alias("name"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], ranks: dict[str, float]) -> DataFrame:
    """keys, name, docs and the wanted quantiles, from merged sketches."""
    merged = sketch.groupBy(*keys, "name", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "name")
    run = merged.withColumns({"below": F.sum("n").over(group.orderBy("bucket")), "docs": F.sum("n").over(group)})
    value = F.when(F.col("bucket") < 0, F.lit(0.0)).otherwise(LOWEST * F.pow(F.lit(1 + RATIO), F.col("bucket") + 0.5))
    found = {k: F.min(F.when(F.col("below") >= r * F.col("docs"), value)).alias(k) for k, r in ranks.items()}
    return run.groupBy(*keys, "name").agg(F.max("docs").alias("docs"), *found.values())


def thresholds(rows: DataFrame) -> DataFrame:
    """lang, source, an upper bound per value, and a lower one of the word length."""
    sketch = written(sketches(rows), "sketches")
    ranks = {"low": LOW, "mid": 0.5, "high": HIGH}
    own = quantiles(sketch, ["lang", "source"], ranks)
    tongue = quantiles(sketch, ["lang"], ranks).withColumnsRenamed({"lang": "lang2", "name": "name2", "docs": "docs2", **{k: f"{k}2" for k in ranks}})
    every = quantiles(sketch, [], ranks).drop("docs").withColumnsRenamed({k: f"{k}3" for k in ranks})
    both = own.join(tongue, F.col("lang").eqNullSafe(F.col("lang2")) & (F.col("name") == F.col("name2")))
    wide = {k: F.when(F.col("docs2") >= MIN_DOCS, F.col(f"{k}2")).otherwise(F.col(f"{k}3")).alias(f"wide_{k}") for k in ranks}
    near = {k: F.when(F.col("docs") >= MIN_DOCS, F.col(k)).otherwise(F.col(f"wide_{k}")).alias(k) for k in ranks}
    picked = both.join(every, "name").select("lang", "source", "name", "docs", *ranks, *wide.values())
    picked = picked.select("lang", "source", "name", *near.values(), (F.col("wide_high") - F.col("wide_low")).alias("scale"))
    width = F.least(F.greatest(F.col("high") - F.col("low"), F.col("scale") / 2), F.col("scale") * 2)
    bound = {"max": F.col("mid") + SPREAD * width, "min": F.col("mid") - SPREAD * width}
    wanted = [*[("max", k) for k in [*SHARES, LENGTH]], ("min", LENGTH)]
    return picked.groupBy("lang", "source").agg(*[F.max(F.when(F.col("name") == k, bound[side])).alias(f"{side}_{k}") for side, k in wanted])


def _with_bounds(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    bounds = bounds.withColumnsRenamed({"lang": "lang of bounds", "source": "source of bounds"})
    same = F.col("lang").eqNullSafe(F.col("lang of bounds")) & F.col("source").eqNullSafe(F.col("source of bounds"))
    return rows.join(bounds, same, "left").drop("lang of bounds", "source of bounds")


def _outside() -> dict[str, Column]:
    """Whether a row is beyond a bound, by the bound; a group without a sketch has no bounds."""
    out = {}
    for name, (part, whole) in SHARES.items():
        expected = F.col(f"max_{name}") * F.col(whole)
        grain = GRAIN[name]
        chance = DEVIATIONS * F.sqrt(grain * expected) + DEVIATIONS**2 * grain
        out[f"max_{name}"] = F.col(part) > expected + chance
    length = values()[LENGTH]
    out[f"max_{LENGTH}"] = length > F.col(f"max_{LENGTH}")
    out[f"min_{LENGTH}"] = length < F.col(f"min_{LENGTH}")
    return {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}


def _inside() -> Column:
    return ~reduce(Column.__or__, _outside().values())


def judged(docs: DataFrame) -> DataFrame:
    """Of every row the columns of CONTRACT, then lang, source, other counts, values, bounds and the names of the bounds it breaks."""
    rows = written(metrics(docs), "metrics")
    joined = _with_bounds(rows, written(thresholds(rows), "thresholds"))
    broken = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in _outside().items()]), lambda x: x.isNotNull())
    full = joined.withColumns({**values(), "base_failed": base_failed(), "broken": F.concat_ws(",", broken), "kept": ~base_failed() & _inside()})
    return full.select(*CONTRACT, *[c for c in full.columns if c not in CONTRACT])


def rejections(judged_rows: DataFrame) -> DataFrame:
    """lang, source, docs that pass the base rule, and how many of them each bound rejects."""
    rows = judged_rows.filter(~F.col("base_failed")).withColumn("broken", F.split("broken", ","))
    names = _outside()
    return rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"), *[F.count_if(F.array_contains("broken", k)).alias(k) for k in names])


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with all their columns as they are."""
    rows = written(metrics(docs), "metrics")
    bounds = written(thresholds(rows), "thresholds")
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), "lang", "source", counts_column().alias("found"))
    judged_rows = _with_bounds(packed.select("row", "lang", "source", "found.*"), bounds)
    return judged_rows.filter(~base_failed() & _inside()).select("row.*")
