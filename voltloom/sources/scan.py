"""Reading logs and tables from files into the unified shape.

Files are read as one table with their path as a column; a directory of a
thousand small files is one scan, not a loop.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltloom import schema


def table_of(spark: SparkSession, path: str, columns: str | None = None, separator: str = ",") -> DataFrame:
    """CSV, TXT (with its separator named), JSON or Parquet by suffix; other suffixes raise."""
    reader = spark.read if columns is None else spark.read.schema(columns)
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "txt"):
        return reader.option("header", True).option("sep", separator).csv(path)
    if suffix == "json":
        return reader.json(path)
    if suffix == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unsupported file type: .{suffix}")


def unified_csv(spark: SparkSession, path: str, constants: Mapping[str, str] | None = None,
                extra: Mapping[str, str] | None = None) -> DataFrame:
    """Header CSV of telemetry → typed unified rows with derived columns."""
    raw = spark.read.option("header", True).csv(path)
    return schema.derive(schema.coerce(schema.standardize(raw, constants, extra)))


def single_run(spark: SparkSession, path: str) -> DataFrame:
    """One file → unified columns with provenance; mode by the current's sign alone.

    Raises when none of voltage, current, temperature and capacity has a value.
    """
    raw = table_of(spark, path)
    df = schema.coerce(schema.standardize(raw)).withColumn("source_file", F.col("_metadata.file_name"))
    have = [c for c in ("voltage_v", "current_a", "temperature_c", "capacity_ah") if c in df.columns]
    if not have or not any(df.agg(*[F.count(c) for c in have]).first()):
        raise ValueError(f"no usable measurement column in {path}")
    i = F.col("current_a")
    return df.withColumn("mode_guess", F.when(i > 0, "charge").when(i < 0, "discharge").when(i == 0, "rest")
                         .otherwise("unknown")) if "current_a" in df.columns else df


#: Charge of a new cell where a run has no measured capacity.
NOMINAL_AH = 2.0


def runs_with_manifest(runs: DataFrame, manifest: DataFrame, include_charge: bool = True) -> DataFrame:
    """Run files joined to a manifest (battery_id, uid, type, filename, capacity, ambient).

    Discharges are numbered by uid; a charge takes the next discharge's number;
    rows after the last discharge are dropped. A discharge without a positive
    capacity is measured against the nominal one and reports no capacity_ah.
    The manifest has one row per run file, so its window is small; the samples
    are summed inside their own run.
    """
    kinds = ["charge", "discharge"] if include_charge else ["discharge"]
    w = Window.partitionBy("battery_id").orderBy("uid")
    number = F.sum((F.col("type") == "discharge").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    listed = manifest.where(F.col("type").isin("charge", "discharge")).withColumn(
        "_d", F.when(F.col("type") == "discharge", number)).withColumn(
        "cycle", F.first("_d", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).where(
        F.col("cycle").isNotNull() & F.col("type").isin(*kinds)).drop("_d")
    rows = runs.join(listed, "filename")
    t, i = F.col("test_time_s"), F.col("current_a")
    own = Window.partitionBy("filename").orderBy("test_time_s", "seq")
    dt = F.greatest(t - F.lag(t).over(own), F.lit(0.0))
    used = F.sum(F.coalesce(F.abs(i) * dt, F.lit(0.0)) / 3600.0).over(
        own.rowsBetween(Window.unboundedPreceding, 0))
    last = F.row_number().over(Window.partitionBy("filename").orderBy(F.desc("test_time_s"), F.desc("seq"))) == 1
    measured = F.col("capacity") > 0
    drained = 100 * (1 - F.col("_used") / F.when(measured, F.col("capacity")).otherwise(NOMINAL_AH))
    filled = 100 * F.col("_used") / NOMINAL_AH
    is_dis = F.col("type") == "discharge"
    return rows.withColumns({"_used": used, "_last": last}).withColumns({
        "soc": F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(is_dis, drained).otherwise(filled))),
        "capacity_ah": F.when(is_dis & F.col("_last") & measured, F.col("capacity")),
    }).withColumnRenamed("battery_id", "cell_id").drop("_used", "_last")


_STAMP = r"_(\d{1,2})_(\d{1,2})_(\d{2})\.[A-Za-z]+$"


def file_order(path: Column) -> Column:
    """Date of a cycler export from its name (M_D_YY)."""
    part = lambda i: F.regexp_extract(path, _STAMP, i)
    return F.when(part(1) != "", F.make_date(part(3).cast("int") + 2000, part(1).cast("int"), part(2).cast("int")))


def cell_directory(spark: SparkSession, path: str, columns: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """All exports below a directory as one log, and a report per file.

    The cell is the name of the file's directory. ``columns`` maps header
    names to types; a row whose text does not fit them is kept out of the log
    and counted in the report.
    """
    text = ", ".join(f"{c} STRING" for c in columns)
    raw = (spark.read.schema(text).option("header", True).option("recursiveFileLookup", True).csv(path)
           .withColumns({"path": F.col("_metadata.file_path"), "mtime": F.col("_metadata.file_modification_time")}))
    bad = F.lit(False)
    for c, t in columns.items():
        bad = bad | (F.col(c).isNotNull() & F.col(c).try_cast(t).isNull())
    rows = raw.withColumn("_bad", bad)
    # What the path tells is read once a file, not once a row.
    files = rows.groupBy("path", "mtime").agg(F.count_if(~F.col("_bad")).alias("n_rows"), F.count_if("_bad").alias("n_bad"))
    report = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("cell_id"), "path",
                          file_order(F.col("path")).alias("file_date"), "mtime", "n_rows", "n_bad")
    w = Window.partitionBy("cell_id").orderBy(F.asc_nulls_last("file_date"), "mtime", "path")
    report = report.withColumn("file_no", F.row_number().over(w)).withColumn(
        "status", F.when(F.col("n_rows") == 0, "skipped: no readable row").when(F.col("n_bad") > 0, "partly read")
        .otherwise("read"))
    log = rows.where(~F.col("_bad")).drop("_bad").withColumns(
        {c: F.col(c).try_cast(t) for c, t in columns.items()}).join(
        report.select("path", "cell_id", "file_date", "file_no"), "path")
    return log, report


def cohort_of_path(path: Column) -> Column:
    """Cohort from a ``Type N`` directory and the letters that open the cell name."""
    kind = F.regexp_extract(path, r"[Tt]ype[ _]?(\d+)", 1)
    family = F.regexp_extract(path, r"([A-Za-z]+\d*)_\d+/[^/]+$", 1)
    return F.when((kind != "") & (family != ""), F.concat(family, F.lit("_TYPE_"), kind))


def nested_blocks(records: DataFrame, nominal_ah: float) -> DataFrame:
    """cell → cycle → block{t,v,q,temp} records as long rows.

    Blocks with unequal array lengths are left out. The charge unit is told for
    each cell from its largest |q| against the nominal capacity; where neither
    Ah nor mAh fits, q stays as it is and ``unit`` says so.
    """
    blocks = records.select("cell_id", "cycle", F.explode("blocks").alias("measurement", "b"))
    even = (F.size("b.t") == F.size("b.v")) & (F.size("b.v") == F.size("b.q")) & (F.size("b.q") == F.size("b.temp"))
    flat = blocks.withColumn("missing", ~F.coalesce(even, F.lit(False)))
    rows = flat.where("NOT missing").select("cell_id", "cycle", "measurement", F.inline(F.arrays_zip(
        F.col("b.t").alias("test_time_s"), F.col("b.v").alias("voltage_v"), F.col("b.q").alias("q"),
        F.col("b.temp").alias("temperature_c"))))
    share = F.max(F.abs("q")) / F.lit(nominal_ah)
    unit = F.when(share.between(0.2, 5.0), "Ah").when((share / 1000.0).between(0.2, 5.0), "mAh").otherwise("unknown")
    units = rows.groupBy("cell_id").agg(unit.alias("unit"))
    scale = F.when(F.col("unit") == "mAh", 0.001).otherwise(1.0)
    return rows.join(units, "cell_id").withColumn("capacity_ah_curve", F.abs("q") * scale).drop("q")


def discharge_records(records: DataFrame, load_a: float = 0.05, least: int = 5) -> DataFrame:
    """Per-discharge sample arrays as rows, from the first loaded sample on.

    Discharges with under five samples below -0.05 A are dropped.
    """
    loaded = F.filter("current", lambda i: i < -load_a)
    good = records.where(F.size(loaded) >= least)
    rows = good.select("cell_id", "cycle", "ambient_c", F.posexplode(F.arrays_zip("time", "voltage", "current", "temperature"))
                       .alias("pos", "s"), F.array_position(F.transform("current", lambda i: i < -load_a), True).alias("_start"))
    return rows.where(F.col("pos") + 1 >= F.col("_start")).select(
        "cell_id", "cycle", "ambient_c", F.col("s.time").alias("test_time_s"), F.col("s.voltage").alias("voltage_v"),
        F.col("s.current").alias("current_a"), F.col("s.temperature").alias("temperature_c"))


def condition_label(discharges: DataFrame) -> DataFrame:
    """(cell_id, cohort): median ambient and median load of a cell."""
    from voltloom.operators.ordered import exact_quantiles
    per = discharges.groupBy("cell_id", "cycle").agg(F.first("ambient_c").alias("a"), F.avg(F.abs("current_a")).alias("i"))
    mid = exact_quantiles(per, ["cell_id"], "a", {"am": 0.5}).join(exact_quantiles(per, ["cell_id"], "i", {"im": 0.5}), "cell_id")
    return mid.select("cell_id", F.concat(F.format_string("%.0f", F.bround("am", 0)), F.lit("C_"),
                                          F.format_string("%.1f", F.bround("im", 1)), F.lit("A")).alias("cohort"))


@dataclass(frozen=True)
class Dataset:
    """A named table: where it is, how its columns map, and a constant cohort."""

    name: str
    path: str
    columns: Mapping[str, str] | None = None
    cohort: str | None = None

    def load(self, spark: SparkSession, check: bool = True) -> DataFrame:
        """The cycle-level frame; refuses an unsuitable dataset unless told otherwise."""
        from voltloom.operators.cohorts import suitability
        df = table_of(spark, self.path).withColumnsRenamed(dict(self.columns or {}))
        if self.cohort is not None:
            df = df.withColumn("cohort", F.lit(self.cohort))
        if check:
            verdict = suitability(df).first()
            if not verdict["suitable"]:
                raise ValueError(f"dataset {self.name} is unsuitable: {verdict['blockers']}")
        return df


def write_stages(stages: Mapping[str, DataFrame], folder: str) -> None:
    """Each stage as its own Parquet table."""
    for name, df in stages.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def append_new(inputs: DataFrame, folder: str, key: str, build) -> int:
    """Resume a long build: only keys not yet in the folder are built and appended.

    A column that appears later is merged into the table's schema.
    """
    spark = inputs.sparkSession
    try:
        done = spark.read.option("mergeSchema", True).parquet(folder).select(key).distinct()
        todo = inputs.join(done, key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = inputs
    fresh = build(todo)
    fresh.write.mode("append").parquet(folder)
    return todo.select(key).distinct().count()
