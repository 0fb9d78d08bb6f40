"""Time-series points: a measurement with tags, fields and a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardflow.functions.scalar import as_number, own_name
from hazardflow.operators.profile import is_numeric_type
from hazardflow.schema import FILE_KEY


def time_column(frame: DataFrame) -> str | None:
    """First column whose name holds `time` or `date`."""
    return next((c for c in frame.columns if "time" in c.lower() or "date" in c.lower()), None)


def to_points(
    frame: DataFrame,
    measurement: str,
    ts_col: str | None = None,
    now=None,
    key: str = FILE_KEY,
    types: str | None = None,
) -> DataFrame:
    """Numeric columns become fields, text columns become tags; NULLs are left out.

    `types` names a map from column to type name (as in a validation table) that
    tells for each row which text columns hold numbers. Rows without a time get
    `now`, which the caller passes in.
    """
    ts_col = ts_col or time_column(frame)
    data = [f for f in frame.schema.fields if f.name not in (ts_col, key, types)]
    numbers = {f.name: F.col(f"`{f.name}`") for f in data if isinstance(f.dataType, T.NumericType)}
    texts = {f.name: F.col(f"`{f.name}`") for f in data if isinstance(f.dataType, T.StringType)}
    fields, tags = dict(numbers), dict(texts)
    if types is not None:
        for c, value in texts.items():
            kind = F.try_element_at(types, F.lit(c))
            fields[c] = F.when(is_numeric_type(kind), as_number(value))
            tags[c] = F.when(kind == "object", value)

    def present(columns: dict[str, Column], kind: str) -> Column:
        spelled: dict[str, Column] = {}
        for c, value in columns.items():  # of one file only one spelling has values
            name = own_name(c)
            spelled[name] = F.coalesce(spelled[name], value) if name in spelled else value
        columns = spelled
        if not columns:
            return F.create_map().cast(f"map<string,{kind}>")
        pairs = [x for c, value in columns.items() for x in (F.lit(own_name(c)), value.cast(kind))]
        empty = (lambda v: v.isNull() | F.isnan(v)) if kind == "double" else (lambda v: v.isNull())
        return F.map_filter(F.create_map(*pairs), lambda _, v: ~empty(v))

    fallback = F.lit(now).cast("timestamp")
    ts = F.coalesce(F.col(ts_col).try_cast("timestamp"), fallback) if ts_col else fallback
    return frame.select(
        *([key] if key in frame.columns else []),
        F.lit(measurement).alias("measurement"),
        present(tags, "string").alias("tags"),
        present(fields, "double").alias("fields"),
        ts.alias("ts"),
    )


def _entries(column: str) -> Column:
    ordered = F.array_sort(F.map_entries(column))
    return F.array_join(
        F.transform(ordered, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","
    )


def points_text(points: DataFrame) -> DataFrame:
    """One line per point: measurement, tags, fields, time; entries sorted by name."""
    head = F.concat_ws(",", "measurement", F.when(F.size("tags") > 0, _entries("tags")))
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return points.select(F.concat_ws(" ", head, _entries("fields"), ts).alias("value"))


def points_long(points: DataFrame) -> DataFrame:
    """(ts, measurement, field, value) for every field of every point."""
    return points.select("ts", "measurement", F.explode("fields").alias("field", "value"))
