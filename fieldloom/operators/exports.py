"""Reading fields: the 23 directions, maps, point series, extensometers, stretch, and CSV sinks."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import filesystem, kept

#: Direction -> (table, measure, unit, whether its map is stretched).  c: cumulative, i: incremental.
DIRECTIONS = {
    "DX": ("c", "dx", "mm", True), "DY": ("c", "dy", "mm", True), "DABS": ("c", "dabs", "mm", True),
    "D_DX": ("i", "dx", "mm", False), "D_DY": ("i", "dy", "mm", False), "D_DABS": ("i", "dabs", "mm", False),
    "R_DX": ("i", "dx", "mm/ms", False), "R_DY": ("i", "dy", "mm/ms", False), "R_DABS": ("i", "dabs", "mm/ms", False),
    "EXX": ("c", "exx", "%", True), "EYY": ("c", "eyy", "%", True), "EXY": ("c", "exy", "%", True), "EABS": ("c", "eabs", "%", True),
    "D_EXX": ("i", "exx", "%", False), "D_EYY": ("i", "eyy", "%", False), "D_EXY": ("i", "exy", "%", False), "D_EABS": ("i", "eabs", "%", False),
    "Q_D": ("c", "quality", "%", True), "Q_D_D": ("i", "quality", "%", False),
    "O_EX": ("c", "err_u", "1", True), "O_EY": ("c", "err_v", "1", True), "O_D_EX": ("i", "err_u", "1", False), "O_D_EY": ("i", "err_v", "1", False),
}

#: What a two-point chart shows for a direction.
CHART = {"DX": "EXX", "R_DX": "EXX", "DY": "EYY", "R_DY": "EYY", "DABS": "EABS", "R_DABS": "EABS", "D_DX": "D_EXX", "D_DY": "D_EYY", "D_DABS": "D_EABS"}


def measure(name: str) -> Column:
    c = F.col
    return {"dabs": F.sqrt(c("dx") * c("dx") + c("dy") * c("dy")), "eabs": F.sqrt(c("exx") * c("exx") + c("eyy") * c("eyy") + c("exy") * c("exy"))}.get(name, F.col(name))


def values(cumulative: DataFrame, incremental: DataFrame, directions: list[str], mm_ratio: float = 1.0, fps: float = 5000.0) -> DataFrame:
    """round, x, y, direction, value of wide field tables (round, x, y, dx, dy, quality, exx, eyy, exy, err_u, err_v).

    Both tables are scanned once, whatever the number of directions."""

    def one(table: DataFrame, kind: str) -> DataFrame | None:
        mine = [d for d in directions if DIRECTIONS[d][0] == kind]
        if not mine:
            return None
        out = []
        for d in mine:
            _, m, unit, _ = DIRECTIONS[d]
            v = measure(m)
            if unit.startswith("mm"):
                v = v / mm_ratio
            if unit == "mm/ms":
                v = v / (1000.0 / fps)
            out.append(F.struct(F.lit(d).alias("direction"), v.cast("double").alias("value")))
        return table.select("round", "x", "y", F.explode(F.array(*out)).alias("e")).select("round", "x", "y", "e.direction", "e.value")

    parts = [p for p in (one(cumulative, "c"), one(incremental, "i")) if p is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def point_series(table: DataFrame, directions: list[str], x: int, y: int) -> DataFrame:
    """values of one pixel -> a row a round, a column a direction; what is missing is 0."""
    at = table.where((F.col("x") == x) & (F.col("y") == y))
    return at.groupBy("round").pivot("direction", directions).agg(F.first("value")).na.fill(0.0, directions)


def extensometer(field: DataFrame, p1: tuple[int, int], p2: tuple[int, int]) -> DataFrame:
    """Virtual extensometer between two pixels: change of displacement over distance, in per cent, by round.  A distance of
    zero along an axis has no strain there (null)."""
    (x1, y1), (x2, y2) = p1, p2
    a = field.where((F.col("x") == x1) & (F.col("y") == y1)).select("round", F.col("dx").alias("ax"), F.col("dy").alias("ay"))
    b = field.where((F.col("x") == x2) & (F.col("y") == y2)).select("round", F.col("dx").alias("bx"), F.col("dy").alias("by"))
    lx, ly = float(x2 - x1), float(y2 - y1)
    du, dv = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    none = F.lit(None).cast("double")
    exx, eyy = (du * 100 / lx if lx else none), (dv * 100 / ly if ly else none)
    exy = (du / ly + dv / lx) * 50 if lx and ly else none
    out = a.join(b, "round").select("round", exx.alias("exx"), eyy.alias("eyy"), exy.alias("exy"))
    return out.withColumn("eabs", F.sqrt(F.coalesce(F.col("exx") * F.col("exx"), F.lit(0.0)) + F.coalesce(F.col("eyy") * F.col("eyy"), F.lit(0.0)) + F.coalesce(F.col("exy") * F.col("exy"), F.lit(0.0))))


def stretch_factor(incremental: DataFrame, cumulative: DataFrame) -> DataFrame:
    """factor: last row with data of the incremental field over that of the cumulative one, 1 if either has none."""
    last = lambda df, name: df.agg(F.max("y").cast("double").alias(name))
    both = last(incremental, "i").crossJoin(last(cumulative, "c"))  # one row each
    return both.select(F.coalesce(F.col("i") / F.nullif("c", F.lit(0.0)), F.lit(1.0)).alias("factor"))


def stretched(table: DataFrame, factor: float, height: int, keys: list[str]) -> DataFrame:
    """Destination row y blends the source rows around y / factor; rows that would need one beyond the last are left out.

    Source rows know which destination rows they serve, so this is two equi-joins on rows, not a search."""
    dest = table.sparkSession.range(height).select(F.col("id").alias("y"), (F.col("id") / factor).alias("p"))
    dest = dest.withColumn("lo", F.floor("p")).withColumn("hi", F.ceil("p")).withColumn("t", F.col("p") - F.floor("p")).where(F.col("hi") <= height - 1)
    lo = table.select(*keys, "x", F.col("y").alias("lo"), F.col("value").alias("a"))
    hi = table.select(*keys, "x", F.col("y").alias("hi"), F.col("value").alias("b"))
    out = F.broadcast(dest).join(lo, "lo").join(hi, [*keys, "x", "hi"])  # one row a row of the frame
    return out.select(*keys, "x", "y", (F.col("a") * (1 - F.col("t")) + F.col("b") * F.col("t")).alias("value"))


def clamped(value: Column, low: float | None, high: float | None) -> Column:
    out = value if low is None else F.greatest(value, F.lit(low))
    return out if high is None else F.least(out, F.lit(high))


def finite_range(table: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Least and largest finite value, 0 and 0 where there is none."""
    v = F.col(value)
    ok = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)
    return table.groupBy(*keys).agg(F.coalesce(F.min(ok), F.lit(0.0)).alias("low"), F.coalesce(F.max(ok), F.lit(0.0)).alias("high"))


def colour_index(value: Column, low: Column, high: Column, entries: int = 1000, absolute: bool = False) -> Column:
    """Nearest entry of a table of entries + 1 colours; null for what is out of range.  Of an empty range, the middle."""
    t = value / F.nullif(high, F.lit(0.0)) / 2 + 0.5 if absolute else F.when(high > low, (value - low) / F.nullif(high - low, F.lit(0.0))).otherwise(F.lit(0.5))
    return F.when((t >= 0) & (t <= 1), F.floor(t * entries))


#: Share of the colour over the frame's grey; sizes of the colour bar beside and below.
ALPHA, BAR_RIGHT, BAR_BOTTOM = 0.75, 30, 15


def palette(t: Column) -> list[Column]:
    """Blue, green, red (0..255) of a place 0..1 in the palette: blue, cyan, yellow, red, by straight ramps."""
    ramp = lambda middle: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.5 - F.abs(t * 4 - middle))) * 255 + 0.5)
    return [ramp(1), ramp(2), ramp(3)]


def overlay(frame: DataFrame, table: DataFrame, keys: list[str], width: int, height: int, right: bool = True) -> DataFrame:
    """keys, x, y, b, g, r: a picture for each map of ``table`` (keys, x, y, value): the frame (x, y, g) in grey, the values'
    colours over it by ALPHA, between the least and largest finite one, and a colour bar beside or below it."""
    span = finite_range(table, keys)
    grey = frame.where((F.col("x") < width) & (F.col("y") < height)).select("x", "y", F.greatest(F.lit(0), F.least(F.lit(255), F.col("g"))).cast("long").alias("grey"))
    pictures = grey.join(F.broadcast(span), how="cross")  # the frame once a map, as asked for
    both = pictures.join(table, [*keys, "x", "y"], "left")
    t = F.when(F.col("value").isNotNull(), F.when(F.col("high") > F.col("low"), (F.col("value") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))).otherwise(F.lit(0.5)))
    mixed = [F.when(t.isNull(), F.col("grey")).otherwise(F.floor(c * ALPHA + F.col("grey") * (1 - ALPHA) + 0.5)) for c in palette(t)]
    names = ("b", "g", "r")
    picture = both.select(*keys, "x", "y", *[c.cast("long").alias(n) for c, n in zip(mixed, names, strict=True)])
    long_, short = (height, BAR_RIGHT) if right else (width, BAR_BOTTOM)
    bar = span.select(*keys).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(long_ - 1).cast("long")))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(short - 1).cast("long"))))
    place = 1 - F.col("i") / max(1, long_ - 1) if right else F.col("i") / max(1, long_ - 1)
    x, y = (F.col("j") + width, F.col("i")) if right else (F.col("i"), F.col("j") + height)
    return picture.unionByName(bar.select(*keys, x.alias("x"), y.alias("y"), *[c.cast("long").alias(n) for c, n in zip(palette(place), names, strict=True)]))


def pictures(coloured: DataFrame, keys: list[str]) -> DataFrame:
    """keys, width, height, g: the pixels of each picture (keys, x, y, b, g, r), row by row, three levels each."""
    rows = coloured.groupBy(*keys).agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"), F.sort_array(F.collect_list(F.struct("y", "x", "b", "g", "r"))).alias("p"))
    return rows.select(*keys, "width", "height", F.flatten(F.transform("p", lambda p: F.array(p["b"], p["g"], p["r"]))).alias("g"))


def six_decimals(value: float | None) -> str:
    """A finite value rounded from its exact binary value, ties to even, as printf does; Java's formatter rounds the shortest
    decimal, ties up.  NaN for no data."""
    if value is None or math.isnan(value):
        return "NaN"
    return "%.6f" % value if math.isfinite(value) else "Infinity" if value > 0 else "-Infinity"


def csv_rows(table: DataFrame, width: int, keys: list[str]) -> DataFrame:
    """A map as text lines: keys, y, line; a comma after every value, NaN for no data."""
    cells = table.groupBy(*keys, "y").agg(F.map_from_entries(F.collect_list(F.struct(F.col("x").cast("int").alias("x"), F.col("value").cast("double").alias("value")))).alias("m"))

    @F.arrow_udf("string")
    def line(rows: pa.Array) -> pa.Array:
        return pa.array(["".join(six_decimals(v) + "," for v in row) for row in rows.to_pylist()], pa.string())

    values = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.element_at("m", x))
    return cells.select(*keys, "y", line(values).alias("line"))


def write_map(table: DataFrame, path: str, width: int) -> None:
    csv_rows(table, width, []).repartition(1).sortWithinPartitions("y").select("line").write.mode("overwrite").text(path)


def write_sequence(table: DataFrame, folder: str, width: int, prefix: str = "map") -> DataFrame:
    """round, file, lines: one CSV map a round, written to ``folder`` as <prefix>-<round, two digits at least>.csv.  A round's
    lines go to one task, in order; a task that runs twice writes the same files."""
    lines = csv_rows(table, width, ["round"])

    def run(batches):
        files, base = filesystem(folder)
        files.create_dir(base, recursive=True)
        current, out, n = None, None, 0
        done = []
        for batch in batches:
            for r, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if r != current:
                    if out is not None:
                        out.close()
                        done.append((current, n))
                    current, n = r, 0
                    out = files.open_output_stream(f"{base}/{prefix}-{r:02d}.csv")
                out.write(line.encode("utf-8") + b"\n")
                n += 1
        if out is not None:
            out.close()
            done.append((current, n))
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.int64()), pa.array([f"{prefix}-{r:02d}.csv" for r, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["round", "file", "lines"])

    dealt = lines.select(F.col("round").cast("long").alias("round"), "y", "line").repartition("round").sortWithinPartitions("round", "y")
    return kept(dealt.select("round", "line").mapInArrow(run, "round long, file string, lines long"), "csv-manifest")


class Viewer:
    """A field that a viewer asks for map after map and series after series: cached as long as it is open."""

    def __init__(self, field: DataFrame):
        self.field = field.cache()

    def map(self, round_: int) -> DataFrame:
        return self.field.where(F.col("round") == round_)

    def series(self, x: int, y: int) -> DataFrame:
        return self.field.where((F.col("x") == x) & (F.col("y") == y))

    def __enter__(self) -> Viewer:
        return self

    def __exit__(self, *_) -> None:
        self.field.unpersist()


def keyed(table: DataFrame, rows: list[str], column: str, value: str, columns: list) -> DataFrame:
    """A two-level table for a quoted CSV: a row a key, a column a second key."""
    return table.groupBy(*rows).pivot(column, columns).agg(F.first(value))


def output_name(parts: list[Column], extension: str) -> Column:
    return F.concat(F.concat_ws("-", *parts), F.lit("." + extension))


def parse_spec(text: Column) -> Column:
    """mode;target;direction;path[;ints] -> a struct; the direction 'null' is D_DY."""
    p = F.split(text, ";")
    at = lambda k: F.get(p, F.lit(k))
    return F.struct(at(0).alias("mode"), at(1).alias("target"), F.when(at(2) == "null", F.lit("D_DY")).otherwise(at(2)).alias("direction"), at(3).alias("path"), F.transform(F.slice(p, 5, F.greatest(F.size(p) - 4, F.lit(0))), lambda v: F.trim(v).cast("int")).alias("arguments"))
