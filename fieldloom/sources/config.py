"""Task configuration: text files, defaults, validation, snapshots.

A line is ``key :: value`` or ``key = value``.  ``ROI_<round>`` holds ``;;``-separated triples region--limits--size (NONE:
absent), ``PARAM_<name>`` a parameter, typed by its name; decimal commas are read; a line that can't be read is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parameters, their type and default (None: required or derived).
PARAMETERS: dict[str, tuple[type, object]] = {
    "IN": (str, None), "ROUND_LIMITS": (list, None), "SUBSET_SIZE": (int, 10), "SUBSET_GENERATOR_METHOD": (str, "EQUAL"), "SUBSET_GENERATOR_PARAM": (int, 5),
    "DEFORMATION_ORDER": (str, "FIRST"), "DEFORMATION_LIMITS": (list, None), "SOLVER": (str, "NEWTON_RHAPSON_CENTRAL"), "CORRELATION_WEIGHT": (float, 0.75), "INTERPOLATION": (str, "BICUBIC"),
    "FILTER_KERNEL_SIZE": (int, 5), "DISPLACEMENT_CALCULATION_METHOD": (str, "MAX_WEIGHTED_AVERAGE"), "DISPLACEMENT_CALCULATION_PARAM": (int, 2000), "RESULT_QUALITY": (float, 0.25),
    "STRAIN_ESTIMATION_METHOD": (str, "LOCAL_LEAST_SQUARES"), "STRAIN_ESTIMATION_PARAM": (float, 20.0), "MM_TO_PX_RATIO": (float, 1.0), "FPS": (int, 5000),
    "TASK_SPLIT_METHOD": (str, "DYNAMIC"), "TASK_SPLIT_PARAM": (int, 1000), "KERNEL": (str, "ANY"),
}
#: Default limits by order.
LIMITS = {
    "ZERO": [-5.0, 5.0, 0.01] * 2,
    "FIRST": [-5.0, 5.0, 0.5] * 2 + [-0.25, 0.25, 0.05] * 4,
}
#: Spacing of the mesh presets.
SCENARIOS = {"default": 5, "precise": 1, "coarse": 10}
ORDER_OF_LENGTH = {6: "ZERO", 18: "FIRST", 36: "SECOND"}


def validated(task: dict, frames: int) -> dict:
    """The task with defaults filled in; an error for what can't be computed."""
    if not task.get("IN"):
        raise ValueError("no input")
    unknown = set(task) - set(PARAMETERS)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    out = {k: task.get(k, default) for k, (_, default) in PARAMETERS.items()}
    for k, (kind, _) in PARAMETERS.items():
        if out[k] is not None and not isinstance(out[k], (kind, int) if kind is float else kind):
            raise TypeError(f"{k}: {kind.__name__} expected")
    out["ROUND_LIMITS"] = out["ROUND_LIMITS"] or [0, frames - 1]
    if len(out["ROUND_LIMITS"]) != 2 or out["ROUND_LIMITS"][0] > out["ROUND_LIMITS"][1]:
        raise ValueError("illegal round limits")
    if out["DEFORMATION_LIMITS"] is None:
        out["DEFORMATION_LIMITS"] = LIMITS["ZERO" if out["DEFORMATION_ORDER"] == "ZERO" else "FIRST"]
    if len(out["DEFORMATION_LIMITS"]) not in ORDER_OF_LENGTH:
        raise ValueError("illegal number of limits")
    out["DEFORMATION_ORDER"] = ORDER_OF_LENGTH[len(out["DEFORMATION_LIMITS"])]
    out["FILTER_KERNEL_SIZE"] += 1 if out["FILTER_KERNEL_SIZE"] > 0 and out["FILTER_KERNEL_SIZE"] % 2 == 0 else 0
    return out


def properties(lines: DataFrame, column: str = "value") -> DataFrame:
    """Text lines -> key, value; comments and lines without a separator are left out."""
    text = F.trim(F.col(column))
    split = F.regexp_extract_all(text, F.lit(r"^([^=]*?)\s*(?:::|=)\s*(.*)$"), 1)
    value = F.regexp_extract(text, r"^([^=]*?)\s*(?:::|=)\s*(.*)$", 2)
    out = lines.select("*", F.get(split, F.lit(0)).alias("key"), value.alias("val")).where(~text.startswith("#") & (F.col("key") != ""))
    return out.drop(column).withColumnRenamed("val", "value")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return properties(spark.read.text(path))


def as_map(lines: DataFrame) -> DataFrame:
    """One row: the whole file as a map; of repeated keys the last in order of value."""
    return lines.groupBy("key").agg(F.max("value").alias("value")).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("entries"))


def numbers(text: Column) -> Column:
    return F.transform(F.split(F.replace(text, F.lit(","), F.lit(".")), ";"), lambda t: F.trim(t).try_cast("double"))


def regions(lines: DataFrame) -> DataFrame:
    """key, value of a task -> round, roi_no, region, limits, size of its ROI lines."""
    mine = lines.where(F.col("key").rlike(r"^ROI_\d+$"))
    triple = F.split(F.col("t"), "--")
    out = mine.select(F.regexp_extract("key", r"(\d+)$", 1).cast("int").alias("round"), F.posexplode(F.split("value", ";;")).alias("roi_no", "t"))
    part = lambda k: F.trim(F.get(triple, F.lit(k)))
    some = lambda c: F.when((c != "") & (c != "NONE"), c)
    return out.select("round", "roi_no", some(part(0)).alias("region"), numbers(some(part(1))).alias("limits"), some(part(2)).try_cast("int").alias("size"))


def parameters(lines: DataFrame) -> DataFrame:
    """name, value of the known PARAM lines; whole and real ones that can't be read are left out."""
    out = lines.where(F.col("key").startswith("PARAM_")).select(F.substring("key", 7, 100).alias("name"), "value").where(F.col("name").isin(list(PARAMETERS)))
    ints, reals = ([k for k, (t, _) in PARAMETERS.items() if t is kind] for kind in (int, float))
    ok = F.when(F.col("name").isin(ints), F.col("value").try_cast("long").isNotNull()).when(F.col("name").isin(reals), F.replace("value", F.lit(","), F.lit(".")).try_cast("double").isNotNull()).otherwise(F.lit(True))
    return out.where(ok)


def config_lines(rois: DataFrame) -> DataFrame:
    """round, roi_id, region, size -> key, value of the rounds whose regions differ from the round's before."""
    from pyspark.sql import Window as W

    entry = F.concat_ws("--", "region", F.lit("NONE"), F.coalesce(F.col("size").cast("string"), F.lit("NONE")))
    text = rois.groupBy("round").agg(F.concat_ws(";;", F.transform(F.sort_array(F.collect_list(F.struct("roi_id", entry.alias("e")))), lambda e: e["e"])).alias("value"))
    before = F.lag("value").over(W.orderBy("round"))  # one row a round
    return text.withColumn("before", before).where(~F.col("value").eqNullSafe(F.col("before"))).select(F.concat(F.lit("ROI_"), F.col("round").cast("string")).alias("key"), "value")


def sidecar_fps(lines: DataFrame, column: str = "value", default: int = 5000, keys: list[str] | None = None) -> DataFrame:
    """keys, fps: from each file's first line (by line_no, if it is there) that holds "Speed", else the default."""
    keys = keys or []
    speed = F.when(F.col(column).contains("Speed"), F.col(column))
    found = F.min_by(speed, F.when(speed.isNotNull(), F.col("line_no"))) if "line_no" in lines.columns else F.first(speed, ignorenulls=True)
    out = lines.groupBy(*keys).agg(found.alias("t"))
    return out.select(*keys, F.coalesce(F.regexp_extract("t", r"(\d+)", 1).try_cast("int"), F.lit(default)).alias("fps"))


def read_script(spark: SparkSession, path: str) -> DataFrame:
    """config: the task files that a batch list names, one a line; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("config")).where("config != ''")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, size, mtime of a cached sequence, from its SIZE_<file> and MOD_<file> lines, sorted by file."""
    lines = read_config(spark, path)
    kind = F.regexp_extract("key", r"^(SIZE|MOD)_", 1)
    entries = lines.select(kind.alias("kind"), F.regexp_replace("key", r"^(SIZE|MOD)_", "").alias("file"), F.col("value").try_cast("long").alias("v")).where("kind != ''")
    pick = lambda k, name: F.max(F.when(F.col("kind") == k, F.col("v"))).alias(name)
    return entries.groupBy("file").agg(pick("SIZE", "size"), pick("MOD", "mtime")).orderBy("file")


#: Statistics that can be switched on.
SWITCHES = ("GPU_RESULTS", "DEF_USAGE", "DEF_QUALITY", "SUBSET_QUALITY", "POINT_QUALITY", "POINT_STATS", "REGRESSION_QUALITY")


def switches(lines: DataFrame) -> DataFrame:
    """key, value of a properties file -> name, value of every switch: false unless its line says true."""
    names = lines.sparkSession.createDataFrame([(x,) for x in SWITCHES], "name string")
    own = lines.where(F.col("key").isin(*SWITCHES)).groupBy(F.col("key").alias("name")).agg(F.max(F.lower("value") == "true").alias("value"))
    return names.join(own, "name", "left").select("name", F.coalesce("value", F.lit(False)).alias("value"))


def stale_frames(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries (file, size, mtime) that no live file matches; the cache is valid if there are none."""
    return manifest.join(files, ["file", "size", "mtime"], "left_anti")


def save_task(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_task(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
