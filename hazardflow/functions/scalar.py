"""Column expressions: coercion, risk bands, labels, names and time texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardflow.schema import NULL_TOKENS, RISK_STARTS, VARIANT

# Java also reads "1d" or "0x1p3" as numbers; a CSV reader must not.
_NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)\s*$"
_INTEGER = r"^\s*[+-]?\d+\s*$"


def null_if_token(text: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    return F.when(~text.isin(list(tokens)), text)


def as_number(text: Column) -> Column:
    """Text to double; NULL where the text is no number."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def number_text(text: Column) -> Column:
    """One spelling for equal numbers: 1.0, 1.00 and 1e0 are the same value, and whole numbers keep their digits."""
    whole = F.trim(text).try_cast("decimal(38,0)").cast("string")
    plain = F.when(as_number(text) == 0, F.lit(0.0)).otherwise(as_number(text))
    return F.when(looks_integer(text) & whole.isNotNull(), whole).otherwise(plain.cast("string"))


def looks_integer(text: Column) -> Column:
    return text.rlike(_INTEGER)


def coerce(value: Column, kind: str) -> Column:
    """Cast that gives NULL instead of an error."""
    return value.try_cast(kind)


def no_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def risk_level(probability: Column) -> Column:
    """The last band that starts at or below the probability; the first has no lower end."""
    level = F.when(probability.isNotNull(), RISK_STARTS[0][1])
    for start, name in RISK_STARTS[1:]:
        level = F.when(probability >= start, name).otherwise(level)
    return level


def confidence(probability: Column, accuracy: float = 0.95) -> Column:
    return F.least(F.abs(probability - 0.5) * 2 * accuracy, F.lit(1.0))


def predicted_probability(probability: Column, prediction: Column) -> Column:
    return F.element_at(vector_to_array(probability), prediction.cast("int") + 1)


def hazard_probability(probability: Column, classes: Sequence[int]) -> Column:
    """Probability that the row belongs to any of the given classes."""
    values = vector_to_array(probability)
    return sum((F.element_at(values, c + 1) for c in classes), F.lit(0.0))


def risk_text(level: Column) -> Column:
    one_name = F.when(level == "Critical", "Intense").otherwise(level)
    return F.concat(F.upper(one_name), F.lit(" RISK"))


def class_name(code: Column, names: Mapping[int, str]) -> Column:
    pairs = [F.lit(part) for item in names.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), code.cast("int"))


def cut(value: Column, edges: Sequence[float], labels: Sequence[int]) -> Column:
    """Bins closed on the right: label i holds (edge i-1, edge i]."""
    expr = F.when(value <= edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        expr = expr.when(value <= edge, label)
    return expr.when(value.isNotNull() & ~F.isnan(value), labels[len(edges)])


def over_threshold(probability: Column, threshold: float = 0.7) -> Column:
    return probability >= threshold


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def to_naive_utc(ts: Column, zone: str) -> Column:
    """Wall time of a zone to wall time of UTC."""
    return F.to_utc_timestamp(ts, zone)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def output_name(path: Column, run: Column) -> Column:
    return F.concat_ws("_", file_stem(base_name(path)), F.lit("preprocessed"), run)


def batch_id(ts: Column, rows: Column) -> Column:
    return F.concat_ws("_", F.lit("batch"), stamp(ts), rows.cast("string"))


def own_name(name: str) -> str:
    """A column's name as its file spells it."""
    return name.split(VARIANT)[0]


def name_list(names: Column) -> Column:
    """Render an array of names as ['a', 'b']."""
    own = F.transform(names, lambda n: F.substring_index(n, VARIANT, 1))
    return F.concat(F.lit("['"), F.array_join(own, "', '"), F.lit("']"))
