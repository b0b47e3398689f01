"""Text sources. Order-sensitive formats get a line number from a reader that never splits a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER = r"^[+-]?\d+$"
#: Lines of a calibration table at most.
MAX_TABLE = 1_000_000


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0), value; each file is one row of text before it is cut, so numbers are exact."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\r?\n").alias("l"))
    return whole.select("file", F.posexplode("l").alias("line_no", "value"))


def _tokens(c: Column) -> Column:
    return F.split(F.trim(c), r"[,\s]+")


def timing(lines_: DataFrame, keep: str = "last") -> DataFrame:
    """image_id, time of 'id,time' or 'id time' lines; comments and bad rows are skipped, a repeated id keeps its last line."""
    t = _tokens(F.col("value"))
    rows = lines_.where(~F.trim("value").startswith("#")).select("line_no", t.alias("t")).where((F.size("t") >= 2) & F.element_at("t", 1).rlike(r"^\d+$") & F.element_at("t", 2).rlike(NUMBER))
    own = rows.select("line_no", F.element_at("t", 1).cast("int").alias("image_id"), F.element_at("t", 2).cast("double").alias("time"))
    return own.groupBy("image_id").agg((F.max_by if keep == "last" else F.min_by)("time", "line_no").alias("time"))


def timing_columns(lines_: DataFrame, id_at: int = 0, time_at: int = 1, sep: str = r"[,\s]+", as_text: bool = False, order: str = "line_no") -> DataFrame:
    """image_id, time by the place of the columns (from 0), ids as text or whole numbers; comments and bad rows are skipped, a repeated id keeps its last line."""
    t = F.split(F.trim("value"), sep)
    i, x = F.get(t, F.lit(id_at)), F.get(t, F.lit(time_at))
    ok = ~F.trim("value").startswith("#") & x.rlike(NUMBER) & (i != "") & (F.lit(True) if as_text else i.rlike(INTEGER))
    own = lines_.select(order, i.alias("i"), x.alias("x"), ok.alias("ok")).where("ok").select(order, F.col("i").cast("string" if as_text else "int").alias("image_id"), F.col("x").cast("double").alias("time"))
    return own.groupBy("image_id").agg(F.max_by("time", order).alias("time"))


def first_column(lines_: DataFrame, sep: str = r"[,;\s]+", order: str = "line_no") -> DataFrame:
    """order, time: the first token of each line that is a number; headers, comments and other lines are skipped."""
    x = F.get(F.split(F.trim("value"), sep), F.lit(0))
    return lines_.select(order, x.alias("x")).where(F.col("x").rlike(NUMBER)).select(order, F.col("x").cast("double").alias("time"))


def exposure_times(lines_: DataFrame) -> DataFrame:
    """line_id (from 0), tick, seconds: one number per line, in 1e-5 s."""
    own = lines_.where(F.trim("value").rlike(NUMBER)).select("file", "line_no", F.trim("value").cast("double").cast("long").alias("tick"))
    n = F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1
    return own.select("file", n.alias("line_id"), "tick", (F.col("tick") * 1e-5).alias("seconds"))


def blocks(lines_: DataFrame, header: str, keys: list[str] = ("file",), order: str = "line_no") -> DataFrame:
    """Observations of a block file whose blocks end with -99.

    header='gcp': '<id> <name>' then '<image> <u> <v>' rows: gcp_id, gcp_name, image_id, u, v. Lines
    before a block's first one with a whole number and a name are skipped; the last block needs no -99.
    header='image': '<image> <name>' then '<point> <u> <v>' rows; the first line is the header, and a
    last block without -99 is dropped.
    Blank lines and malformed rows are skipped, blocks without rows vanish.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    value = F.trim("value")
    own = lines_.where(value != "").withColumn("value", value)
    own = own.withColumn("end", (F.col("value") == "-99").cast("int"))
    own = own.withColumn("block", F.coalesce(F.sum("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if header == "image":
        own = own.withColumn("closed", F.max("end").over(Window.partitionBy(*keys, "block"))).where("closed = 1").drop("closed")
    own = own.where("end = 0")
    b = Window.partitionBy(*keys, "block").orderBy(order)
    parts = F.split("value", r"\s+", 2)
    fits = (F.size(parts) == 2) & F.element_at(parts, 1).rlike(INTEGER) if header == "gcp" else F.lit(True)
    head = F.first(F.when(fits, F.struct(F.col(order).alias("at"), parts.alias("h"))), ignorenulls=True).over(b.rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("head", head).where(F.col(order) > F.col("head.at")).withColumn("h", F.col("head.h"))
    t = F.split("value", r"\s+")
    ok = (F.size("t") >= 3) & F.element_at("t", 1).rlike(INTEGER) & F.element_at("t", 2).rlike(NUMBER) & F.element_at("t", 3).rlike(NUMBER) & F.element_at("h", 1).rlike(INTEGER)
    own = own.withColumn("t", t).where(ok)
    first = F.element_at("h", 1).cast("int")
    name = F.when(F.size("h") > 1, F.trim(F.element_at("h", 2))).otherwise(F.element_at("h", 1))
    item, u, v = F.element_at("t", 1).cast("int"), F.element_at("t", 2).cast("double"), F.element_at("t", 3).cast("double")
    if header == "gcp":
        return own.select(*keys, "block", first.alias("gcp_id"), name.alias("gcp_name"), item.alias("image_id"), u.alias("u"), v.alias("v"))
    return own.select(*keys, "block", first.alias("image_id"), name.alias("image_name"), item.alias("point_id"), u.alias("u"), v.alias("v"))


def by_point(observations: DataFrame, point: str = "point_id", image: str = "image_id") -> DataFrame:
    """point, views: blocks by image turned round, each point with its (image, u, v), by image."""
    return observations.groupBy(point).agg(F.sort_array(F.collect_list(F.struct(image, "u", "v"))).alias("views"))


def control_points(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """gcp_id, x, y, z; comments are skipped and, with ``header``, each file's first line; a repeated id keeps its last line."""
    return control_rows(lines(spark, path), header)


def control_rows(lines_: DataFrame, header: bool = True, keys: list[str] = ("file",), order: str = "line_no") -> DataFrame:
    rows = lines_.where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    if header:
        rows = rows.withColumn("first", F.min(order).over(Window.partitionBy(*keys))).where(F.col(order) > F.col("first"))
    t = F.split(F.trim("value"), r"\s*,\s*")
    rows = rows.withColumn("t", t).where((F.size("t") >= 4) & F.element_at("t", 2).rlike(NUMBER) & F.element_at("t", 3).rlike(NUMBER) & F.element_at("t", 4).rlike(NUMBER))
    out = rows.select(*keys, order, F.element_at("t", 1).alias("gcp_id"), *[F.element_at("t", k).cast("double").alias(c) for k, c in ((2, "x"), (3, "y"), (4, "z"))])
    return out.groupBy("gcp_id").agg(F.max_by(F.struct("x", "y", "z"), F.struct(*keys, order)).alias("p")).select("gcp_id", "p.*")


def control_points_ecef(points: DataFrame, epsg: int) -> DataFrame:
    """Control points of a map projection (x east, y north, z height over the ellipsoid) as Earth-centred metres."""
    from ..functions.geodesy import geodetic_to_ecef, unproject

    lat, lon = unproject("x", "y", epsg)
    return points.select("gcp_id", *[c.alias(k) for c, k in zip(geodetic_to_ecef(lat, lon, F.col("z"), degrees=True), "xyz", strict=True)])


def correspondence_csv(spark: SparkSession, path: str) -> DataFrame:
    """gcp_id, gcp_name, image_id, u, v of a file with these columns; gcp_name may be missing and is the id then. Other missing columns are an error, rows without numbers are skipped."""
    return correspondences(spark.read.option("header", True).option("comment", "#").csv(path))


def correspondences(df: DataFrame) -> DataFrame:
    missing = [c for c in ("gcp_id", "image_id", "u", "v") if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    number = lambda c, kind: F.col(c).try_cast(kind).alias(c)
    name = F.coalesce(F.col("gcp_name").cast("string"), F.col("gcp_id").cast("string")) if "gcp_name" in df.columns else F.col("gcp_id").cast("string")
    out = df.select(F.col("gcp_id").cast("string").alias("gcp_id"), name.alias("gcp_name"), number("image_id", "int"), number("u", "double"), number("v", "double"))
    return out.where("image_id is not null and u is not null and v is not null")


def plain_csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A file without a header, its columns named and typed by a schema string; # starts a comment, bad numbers are null."""
    return spark.read.schema(columns).option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("mode", "PERMISSIVE").csv(path)


def number_table(spark: SparkSession, path: str, column: int = 0) -> list[float]:
    """A short table of numbers (angles of pixels, wavelengths), one row per line in file order, as a list; comments and other lines are skipped. For calibration files, which have a row per pixel or band."""
    t = F.split(F.trim("value"), r"[,;\s]+")
    rows = lines(spark, path).where(~F.trim("value").startswith("#")).select("file", "line_no", F.get(t, F.lit(column)).alias("x")).where(F.col("x").rlike(NUMBER))
    return [float(r.x) for r in rows.orderBy("file", "line_no").limit(MAX_TABLE).collect()]


def rising(values: list[float]) -> list[float]:
    """A table that can be inverted: an error unless it rises strictly."""
    if any(b <= a for a, b in zip(values, values[1:], strict=False)):
        raise ValueError("the table does not rise strictly")
    return values


def navigation(spark: SparkSession, path: str, **options) -> DataFrame:
    """A trajectory by its file's ending: .sbet and .out are binary records (options as of the nav source), all else a CSV with a header."""
    if path.lower().endswith((".sbet", ".out")):
        from .binary import register

        register(spark)
        return spark.read.format("nav").options(**options).load(path)
    return trajectory_csv(spark, path, **options)


def trajectory_csv(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """time, latitude, longitude, height, roll, pitch, yaw (doubles); ``names`` maps them to the file's; 'heading' serves as yaw."""
    df = spark.read.option("header", True).option("comment", "#").csv(path)
    names = {c: c for c in ("time", "latitude", "longitude", "height", "roll", "pitch", "yaw")} | (names or {})
    if names["yaw"] not in df.columns and "heading" in df.columns:
        names["yaw"] = "heading"
    missing = [v for v in names.values() if v not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(v).cast("double").alias(k) for k, v in names.items()])


#: Names that a point file's columns go by.
SYNONYMS = {
    "name": ("name", "id", "point", "point_id", "punkt", "nr"),
    "easting": ("easting", "east", "e", "x", "y_lv95", "ost"),
    "northing": ("northing", "north", "n", "y", "nord"),
    "height": ("height", "h", "z", "alt", "altitude", "elevation", "hoehe"),
}


def sniff(head: str) -> str:
    """The delimiter of the first characters of a file: tab, semicolon or comma."""
    return "\t" if "\t" in head else ";" if ";" in head else ","


def sniff_column(value: Column) -> Column:
    return F.when(F.contains(value, F.lit("\t")), "\t").when(F.contains(value, F.lit(";")), ";").otherwise(",")


def points_csv(spark: SparkSession, path: str) -> DataFrame:
    """name, easting, northing, height by synonyms; rows without numbers are skipped."""
    head = spark.read.text(path).limit(1).first()
    sep = sniff((head.value if head else "")[:2048])
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    low = {c.strip().lower(): c for c in df.columns}
    pick = {k: next((low[s] for s in names if s in low), None) for k, names in SYNONYMS.items()}
    if not pick["easting"] or not pick["northing"]:
        raise ValueError("no columns for easting and northing")
    get = lambda k, kind: (F.expr(f"try_cast(`{pick[k]}` AS {kind})") if pick[k] else F.lit(None).cast(kind)).alias(k)
    return df.select(get("name", "string"), get("easting", "double"), get("northing", "double"), get("height", "double")).where("easting is not null and northing is not null")


def creation_listing(lines_: DataFrame, zone: str = "digit") -> DataFrame:
    """filename, line_in_name, born, tod of a listing whose lines have nine fields or more: the name first, the birth date and time in the seventh and eighth, the zone in the ninth.

    ``tod`` is the second of the UTC day with all fractional digits, ``born`` the local birth time (to
    the microsecond). zone='digit' takes away the hours that the zone's third character counts, as
    the files were read so far; zone='signed' the whole signed offset. Names without 'Line_<n>' have
    no line; lines with fewer fields or without a time are skipped.
    """
    t = F.split(F.trim("value"), r"\s+")
    own = lines_.withColumn("t", t).where((F.size("t") >= 9) & F.get("t", F.lit(7)).rlike(r"^\d{1,2}:\d{2}:\d{2}(\.\d+)?$"))
    hms, off = F.split(F.get("t", F.lit(7)), ":"), F.get("t", F.lit(8))
    if zone == "digit":
        shift = F.substring(off, 3, 1).try_cast("double") * 3600
    else:
        hours, minutes = F.regexp_extract(off, r"^[+-](\d{2})", 1).try_cast("double"), F.regexp_extract(off, r"^[+-]\d{2}:?(\d{2})", 1).try_cast("double")
        shift = (F.coalesce(hours, F.lit(0.0)) * 3600 + F.coalesce(minutes, F.lit(0.0)) * 60) * F.when(off.startswith("-"), -1).otherwise(1)
    tod = hms[0].cast("double") * 3600 + hms[1].cast("double") * 60 + hms[2].cast("double") - F.coalesce(shift, F.lit(0.0))
    name = F.get("t", F.lit(0))
    line = F.regexp_extract(name, r"Line_(\d+)", 1).try_cast("int")
    born = F.concat_ws(" ", F.get("t", F.lit(6)), F.get("t", F.lit(7))).try_cast("timestamp_ntz")
    return own.select(name.alias("filename"), line.alias("line_in_name"), born.alias("born"), F.pmod(tod, F.lit(86400.0)).alias("tod"))


def exif_times(spark: SparkSession, path: str) -> DataFrame:
    """file, time_ns: the first '#TIMESTAMP = n' of each file."""
    l = lines(spark, path).withColumn("ns", F.regexp_extract("value", r"#TIMESTAMP\s*=\s*(\d+)", 1)).where("ns <> ''")
    return l.groupBy("file").agg(F.min_by(F.col("ns").cast("long"), "line_no").alias("time_ns"))


def uvt_pairs(lines_: DataFrame, order: str = "line_no") -> DataFrame:
    """Lines that name exactly two scan lines: order, side (0 or 1), name."""
    return named_pairs(lines_, order, "value", [r"line_(\d+)"]).select(order, "side", F.concat(F.lit("L"), "name", F.lit("_UVT")).alias("name"))


def named_pairs(df: DataFrame, key: str, value: str, patterns: list[str]) -> DataFrame:
    """key, side (0 or 1), name of the rows in which a few patterns have exactly two hits together, one pattern's after another's."""
    hits = F.concat(*[F.regexp_extract_all(value, F.lit(p), F.lit(1)) for p in patterns])
    return df.select(key, hits.alias("h")).where(F.size("h") == 2).select(key, F.posexplode("h").alias("side", "name"))


def match_rows(lines_: DataFrame) -> DataFrame:
    """u1, idx1, u2, idx2 of lines with exactly four numbers."""
    t = F.split(F.trim("value"), r"\s+")
    ok = lines_.withColumn("t", t).where((F.size("t") == 4) & F.forall("t", lambda x: x.rlike(NUMBER)))
    return ok.select("line_no", *[F.element_at("t", k + 1).cast("double").alias(c) for k, c in enumerate(("u1", "idx1", "u2", "idx2"))])


def match_csv(spark: SparkSession, path: str) -> DataFrame:
    """x1, y1, x2, y2, confidence of a match file without a header; rows without five numbers are skipped."""
    t = F.split(F.trim("value"), r"\s*,\s*")
    ok = lines(spark, path).withColumn("t", t).where((F.size("t") >= 5) & F.forall(F.slice("t", 1, 5), lambda x: x.rlike(NUMBER)))
    return ok.select("line_no", *[F.element_at("t", k + 1).cast("double").alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2", "confidence"))])


def matrix_text(spark: SparkSession, path: str) -> list[list[float]]:
    """A 3 x 3 rotation from a text of nine numbers; anything else, or a matrix that is no rotation, is an error."""
    rows = lines(spark, path).where(~F.trim("value").startswith("#")).orderBy("line_no").select(F.split(F.trim("value"), r"[,;\s]+").alias("t")).limit(16).collect()
    x = [float(v) for r in rows for v in r.t if v]
    if len(x) != 9:
        raise ValueError(f"{len(x)} numbers are no 3 x 3 matrix")
    m = [x[:3], x[3:6], x[6:]]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    det = dot(m[0], (m[1][1] * m[2][2] - m[1][2] * m[2][1], m[1][2] * m[2][0] - m[1][0] * m[2][2], m[1][0] * m[2][1] - m[1][1] * m[2][0]))
    if any(abs(dot(m[i], m[j]) - (i == j)) > 1e-6 for i in range(3) for j in range(3)) or abs(det - 1) > 1e-6:
        raise ValueError("the matrix is no rotation")
    return m


# -- sinks -------------------------------------------------------------------------


def fixed(df: DataFrame, digits: dict[str, int], sep: str = ",") -> DataFrame:
    """One text column: numbers with a fixed count of digits, other columns as they are."""
    return df.select(F.concat_ws(sep, *[F.format_string(f"%.{digits[c]}f", F.col(c).cast("double")) if c in digits else F.col(c).cast("string") for c in df.columns]).alias("value"))


def with_error_literals(df: DataFrame, columns: list[str], digits: int = 8) -> DataFrame:
    """Missing coordinates written as ERROR."""
    return df.select(*[F.when(F.col(c).isNull(), "ERROR").otherwise(F.format_string(f"%.{digits}f", F.col(c))).alias(c) if c in columns else F.col(c) for c in df.columns])


def geo_records(df: DataFrame) -> DataFrame:
    """'GEOXY name x y z PRIORID name' lines."""
    return df.select(F.format_string("GEOXY %s %.3f %.3f %.3f PRIORID %s", "name", "x", "y", "z", "name").alias("value"))


def navigation_csv(nav: DataFrame, path: str) -> None:
    """The navigation records as text: ten columns below a # header, one part file per task."""
    own = nav.select((F.col("time") * 1e5).cast("long").cast("string").alias("time"), *[F.format_string("%.14f", F.degrees(c)) for c in ("latitude", "longitude")], F.format_string("%.6f", "altitude"), *[F.format_string("%.6f", F.degrees(c)) for c in ("roll", "pitch", "platform_heading")], *[F.format_string("%.6f", c) for c in ("x_velocity", "y_velocity", "z_velocity")])
    names = ["#time(10usec)", "latitude", "longitude", "altitude", "roll", "pitch", "heading", "vx", "vy", "vz"]
    own.toDF(*names).write.option("header", True).option("comment", "~").csv(path)  # else the header's # is quoted


def report_lines(summary: DataFrame, per: dict[str, DataFrame], details: DataFrame) -> DataFrame:
    """part, value: a report as JSON lines, written or streamed like any table: the summary, a line per group of each statistic, a line per detail. Nothing is gathered in one row."""
    line = lambda part, df: df.select(F.lit(part).alias("part"), F.to_json(F.struct(*df.columns)).alias("value"))
    out = line("summary", summary)
    for name, df in per.items():
        out = out.unionByName(line(name, df))
    return out.unionByName(line("details", details))
