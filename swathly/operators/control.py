"""Control-point validation from files to report: loaders, poses, the run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Validation
from ..functions import camera
from ..sources import text
from . import asof, geometry, select

POSE = ("latitude", "longitude", "height", "roll", "pitch", "yaw")


def observations(blocks_or_rows: DataFrame, kind: str = "blocks", width: int = 0, height: int = 0, v_up: bool = True) -> DataFrame:
    """gcp_id (text), gcp_name, image_id, u, v in pixels, u_photo, v_photo.

    'blocks' has photo coordinates from the image's centre, which become pixels where the size is
    known and stay as they are where not; 'csv' has pixels.
    """
    own = blocks_or_rows.select(F.col("gcp_id").cast("string").alias("gcp_id"), "gcp_name", "image_id", F.col("u").cast("double").alias("u_photo"), F.col("v").cast("double").alias("v_photo"))
    u, v = camera.photo_to_pixel("u_photo", "v_photo", width, height, v_up) if kind == "blocks" else (F.col("u_photo"), F.col("v_photo"))
    return own.withColumns({"u": u, "v": v})


def load_observations(spark: SparkSession, path: str, kind: str = "blocks", width: int = 0, height: int = 0, v_up: bool = True) -> DataFrame:
    if kind == "blocks":
        return observations(text.blocks(text.lines(spark, path), "gcp"), kind, width, height, v_up)
    return observations(text.correspondence_csv(spark, path), kind)


def poses(trajectory: DataFrame, timing: DataFrame | None = None, width: float = 60.0) -> DataFrame:
    """image_id and a pose for each image that has one.

    With a timing (image_id, time) the trajectory's epochs are interpolated, angles by the short way;
    images outside it have no pose. Without, the trajectory has image_id itself and its last row
    (by ``line_no`` where it has one) counts. A flight is cut into buckets of ``width`` seconds.
    """
    if timing is None:
        missing = [c for c in ("image_id", *POSE) if c not in trajectory.columns]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        order = "line_no" if "line_no" in trajectory.columns else "__n"
        own = trajectory if order == "line_no" else trajectory.withColumn("__n", F.monotonically_increasing_id())
        return select.keep_last(own.select("image_id", *POSE, order), "image_id", order).select("image_id", *POSE)
    epochs = trajectory.groupBy("time").agg(*[F.min(c).alias(c) for c in POSE])
    a, b = asof.bucketed(timing.select("image_id", "time"), epochs, "time", width, list(POSE))
    found = asof.interpolate(a, b, ["b"], "time", list(POSE), ("roll", "pitch", "yaw"))
    return found.where("i_latitude is not null").select("image_id", *[F.col(f"i_{c}").alias(c) for c in POSE])


def of_image(results: DataFrame, image_id: int) -> DataFrame:
    return results.where(F.col("image_id") == image_id)


def of_point(results: DataFrame, gcp_id: str) -> DataFrame:
    return results.where(F.col("gcp_id") == gcp_id)


def ids(results: DataFrame, key: str) -> DataFrame:
    return results.select(key).distinct()


def gaps(seen: DataFrame, points: DataFrame, posed: DataFrame) -> DataFrame:
    """what, key: measured points without coordinates, points never measured, measured images without a pose."""
    one = lambda what, a, b, key: geometry.completeness(a, b, key).select(F.lit(what).alias("what"), F.col(key).cast("string").alias("key"))
    return one("no coordinates", seen, points, "gcp_id").unionByName(one("not measured", points, seen, "gcp_id")).unionByName(one("no pose", seen, posed, "image_id"))


def run(spark: SparkSession, settings: Validation) -> tuple[DataFrame, DataFrame]:
    """All results, and the report as JSON lines."""
    lens = settings.lens
    seen = load_observations(spark, settings.observations, settings.observation_format, lens.width, lens.height, settings.v_up)
    timing = text.timing(text.lines(spark, settings.timing)) if settings.timing else None
    flight = text.navigation(spark, settings.trajectory) if timing is not None else spark.read.option("header", True).option("inferSchema", True).csv(settings.trajectory)
    if timing is not None and "altitude" in flight.columns:  # binary records, in radians
        flight = flight.select("time", *[F.degrees(c).alias(c) for c in ("latitude", "longitude")], F.col("altitude").alias("height"), *[F.degrees(c).alias(c) for c in ("roll", "pitch")], F.degrees("platform_heading").alias("yaw"))
    points = text.control_points(spark, settings.points)
    results = geometry.validate_control(seen, points, poses(flight, timing), lens.as_camera(), settings.mounting.boresight, settings.mounting.lever)
    total, per_point, per_image = geometry.control_report(results, settings.threshold)
    details = geometry.with_sentinels(results).select("gcp_id", "gcp_name", "image_id", "u", "v", "projected_u", "projected_v", "error", "valid", "reason")
    return results, text.report_lines(total, {"per_gcp": per_point, "per_image": per_image}, details)
