"""Fixed names, bounds and codes of the sensor data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The eight features in model order, then the encoded target.
FEATURES = [
    "Duration_days",
    "Energy_Unit_log",
    "Energy_density_Joule_sqr",
    "Volume_m3_sqr",
    "Event_freq_unit_per_day_log",
    "Energy_Joule_per_day_sqr",
    "Volume_m3_per_day_sqr",
    "Energy_per_Volume_log",
]
TARGET = "Intensity_Level_encoded"
REQUIRED = FEATURES + [TARGET]
# Starts the mark of a column whose name differs only in case from another file's.
VARIANT = "\ue000"

SENSOR_SCHEMA = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in FEATURES]
    + [T.StructField(TARGET, T.IntegerType())]
)

# Inclusive scoring bounds per feature.
BOUNDS = {
    "Duration_days": (0.1, 100.0),
    "Energy_Unit_log": (0.0, 10.0),
    "Energy_density_Joule_sqr": (0.0, 10000.0),
    "Volume_m3_sqr": (0.0, 1000.0),
    "Event_freq_unit_per_day_log": (0.0, 10.0),
    "Energy_Joule_per_day_sqr": (0.0, 10000.0),
    "Volume_m3_per_day_sqr": (0.0, 2000.0),
    "Energy_per_Volume_log": (0.0, 10.0),
}

# Class codes, risk bands and the weights of the hazard index.
CLASS_NAMES = {0: "None", 1: "Low", 2: "Medium", 3: "High"}
RISK_STARTS = [(0.0, "Low"), (0.40, "Medium"), (0.55, "High"), (0.75, "Intense")]
RISK_LEVELS = [name for _, name in RISK_STARTS]
HAZARD_WEIGHTS = {
    "Energy_density_Joule_sqr": 0.3,
    "Event_freq_unit_per_day_log": 0.2,
    "Energy_per_Volume_log": 0.3,
    "Energy_Joule_per_day_sqr": 0.2,
}

# The texts a CSV cell may hold for a missing value.
NULL_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

FEEDBACK_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("sensor_data", T.BinaryType()),
        T.StructField("predicted_class", T.IntegerType()),
        T.StructField("corrected_class", T.IntegerType()),
        T.StructField("engineer_id", T.StringType()),
    ]
)

MODEL_RUNS_SCHEMA = T.StructType(
    [
        T.StructField("run_ts", T.TimestampType()),
        T.StructField("model_path", T.StringType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("train_size", T.LongType()),
        T.StructField("val_size", T.LongType()),
        T.StructField("deploy", T.BooleanType()),
        T.StructField("improvement", T.DoubleType()),
        T.StructField("status", T.StringType()),
    ]
)

FILE_KEY = "_file"
EXTRA_CELL = "_extra"
