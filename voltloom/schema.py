"""The unified telemetry schema, its aliases, and the sign and unit rules.

Negative current discharges, positive charges; SOC is percent 0-100; time is
seconds since the start of the log. Missing values are NULL, never NaN.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name, type, unit, required, nullable, description.
FIELDS: tuple[tuple[str, str, str, bool, bool, str], ...] = (
    ("dataset", "string", "text", True, False, "dataset the row comes from"),
    ("source_file", "string", "text", False, True, "file the row was read from"),
    ("cell_id", "string", "text", True, False, "cell, module, pack or vehicle"),
    ("timestamp", "timestamp", "ISO-8601", False, True, "time of the measurement"),
    ("cycle", "int", "cycle number", False, True, "cycle index"),
    ("voltage_v", "double", "V", True, False, "voltage"),
    ("current_a", "double", "A", True, False, "current, discharge negative"),
    ("temperature_c", "double", "°C", True, False, "temperature"),
    ("capacity_ah", "double", "Ah", False, True, "measured or available capacity"),
    ("resistance_ohm", "double", "Ω", False, True, "internal resistance"),
    ("impedance_ohm", "double", "Ω", False, True, "AC impedance"),
    ("soc", "double", "%", False, True, "state of charge"),
    ("soh", "double", "%", False, True, "state of health"),
    ("soc_band", "string", "category", False, True, "range label of soc"),
    ("mode_guess", "string", "category", False, True, "charge, discharge or rest"),
    ("power_w", "double", "W", False, True, "voltage times current"),
    ("label", "string", "category", False, True, "optional target label"),
    ("notes", "string", "text", False, True, "free notes"),
)

# Raw names that stand for a unified column.
ALIASES: Mapping[str, tuple[str, ...]] = {
    "dataset": ("dataset_name", "source"),
    "source_file": ("file", "filename", "sourcefile"),
    "cell_id": ("battery_id", "batteryid", "cell", "cellid", "cell_no", "cell_number", "vehicle_id"),
    "timestamp": ("time", "date_time", "datetime", "test_time"),
    "cycle": ("cycle_index", "cycle_number", "cycle_no", "cycleid"),
    "voltage_v": ("voltage", "voltage(v)", "voltage_measured", "terminal_voltage", "cell_voltage"),
    "current_a": ("current", "current(a)", "current_measured", "load_current", "battery_current"),
    "temperature_c": ("temperature", "temperature(c)", "temp", "temp_c", "temperature_measured",
                      "ambient_temperature"),
    "capacity_ah": ("capacity", "capacity(ah)", "discharge_capacity"),
    "resistance_ohm": ("resistance", "internal_resistance", "dcir"),
    "impedance_ohm": ("impedance", "eis"),
    "soc": ("soc_%", "state_of_charge"),
    "soh": ("soh_%", "state_of_health"),
    "label": ("target", "class", "risk_label"),
}

NAMES = tuple(f[0] for f in FIELDS)
REQUIRED = tuple(f[0] for f in FIELDS if f[3])
NUMERIC = tuple(f[0] for f in FIELDS if f[1] == "double")
NON_NEGATIVE = ("voltage_v", "capacity_ah", "resistance_ohm", "impedance_ohm")
PERCENT = ("soc", "soh")

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(),
          "timestamp": T.TimestampType()}
UNIFIED = T.StructType([
    T.StructField(n, _TYPES[t], True, {"unit": u, "description": d})
    for n, t, u, _, _, d in FIELDS
])


def plain_name(raw: str) -> str:
    name = raw.strip().lower()
    for mark in (" ", "-", "/"):
        name = name.replace(mark, "_")
    return name.replace("__", "_")


def rename_map(columns: Iterable[str], extra: Mapping[str, str] | None = None) -> dict[str, str]:
    """Raw column → unified column; the caller's own aliases win."""
    known = {alias: name for name, group in ALIASES.items() for alias in group}
    known.update({n: n for n in NAMES})
    known.update({plain_name(k): v for k, v in (extra or {}).items()})
    found = {c: known.get(plain_name(c)) for c in columns}
    return {c: n for c, n in found.items() if n in NAMES}


def standardize(df: DataFrame, constants: Mapping[str, str] | None = None,
                extra: Mapping[str, str] | None = None) -> DataFrame:
    """Rename to unified names; add dataset/cell/source constants only when absent."""
    out = df.withColumnsRenamed(rename_map(df.columns, extra))
    missing = {k: F.lit(v) for k, v in (constants or {}).items() if k not in out.columns}
    return out.withColumns(missing) if missing else out


def number(name: str) -> F.Column:
    """A column as DOUBLE, with text that is no number, and NaN, as NULL."""
    as_double = F.col(name).try_cast("double")
    return F.when(~F.isnan(as_double), as_double)


def coerce(df: DataFrame) -> DataFrame:
    casts = {c: number(c) for c in NUMERIC if c in df.columns}
    if "cycle" in df.columns:
        casts["cycle"] = F.col("cycle").try_cast("double").try_cast("int")
    if "timestamp" in df.columns:
        casts["timestamp"] = F.col("timestamp").try_cast("timestamp")
    for name, kind, *_ in FIELDS:
        if kind == "string" and name in df.columns:
            casts[name] = F.col(name).cast("string")
    return df.withColumns(casts)


def soc_band(soc: F.Column) -> F.Column:
    return (F.when(soc.isNull(), "unknown").when(soc < 20, "low_0_20")
            .when(soc < 80, "normal_20_80").when(soc < 90, "elevated_80_90")
            .otherwise("high_90_100"))


def mode(current: F.Column, dead_band_a: float = 0.02) -> F.Column:
    return (F.when(current.isNull(), "unknown").when(current > dead_band_a, "charge")
            .when(current < -dead_band_a, "discharge").otherwise("rest"))


def derive(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    new = {}
    if {"voltage_v", "current_a"} <= have:
        new["power_w"] = F.col("voltage_v") * F.col("current_a")
    if "soc" in have:
        new["soc_band"] = soc_band(F.col("soc"))
    elif "soc_band" not in have:
        new["soc_band"] = F.lit("unknown")
    if "current_a" in have:
        new["mode_guess"] = mode(F.col("current_a"))
    elif "mode_guess" not in have:
        new["mode_guess"] = F.lit("unknown")
    return df.withColumns(new)


def schema_issues(df: DataFrame, strict: bool = True) -> DataFrame:
    """(issue) rows; presence from the schema, values from one aggregate."""
    spark, have = df.sparkSession, set(df.columns)
    absent = [f"Missing required column: {c}" for c in REQUIRED if c not in have]
    if not have & {"cycle", "timestamp"}:
        absent.append("Missing ordering column: provide at least one of cycle or timestamp")
    rules: list[tuple[str, F.Column]] = []
    for c in REQUIRED:
        if c in have:
            rules.append((f"Required column is fully empty: {c}", F.count(c) == 0))
    for c in NUMERIC:
        if c in have and strict:
            rules.append((f"Numeric column could not be parsed: {c}", F.count(number(c)) == 0))
    for c in NON_NEGATIVE:
        if c in have:
            rules.append((f"Column contains negative values but should be non-negative: {c}",
                          F.count_if(number(c) < 0) > 0))
    for c in PERCENT:
        if c in have:
            rules.append((f"Column contains values outside 0–100% range: {c}",
                          F.count_if((number(c) < 0) | (number(c) > 100)) > 0))
    fixed = spark.createDataFrame([(m,) for m in absent], "issue string")
    if not rules:
        return fixed
    flags = df.agg(*[r.alias(f"r{i}") for i, (_, r) in enumerate(rules)])
    found = flags.select(F.explode(F.array_compact(F.array(*[
        F.when(F.col(f"r{i}"), F.lit(text)) for i, (text, _) in enumerate(rules)]))).alias("issue"))
    return fixed.unionByName(found)


def schema_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [f for f in FIELDS],
        "name string, dtype string, unit string, required boolean, nullable boolean, description string")
