"""Surface models: Parquet cells with a row of metadata, and GeoTIFF where a reader for it is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import Grid

try:
    import rasterio
except ImportError:
    rasterio = None


def read_cells(spark: SparkSession, path: str) -> tuple[DataFrame, Grid, int | None]:
    """row, col, z of the valid cells, the grid, and its code, from ``path``/cells and ``path``/meta (x0, y0, res, rows, cols, nodata, epsg)."""
    meta = spark.read.parquet(f"{path}/meta").first()
    cells = spark.read.parquet(f"{path}/cells")
    return valid(cells, meta.nodata), Grid(meta.x0, meta.y0, meta.res, meta.rows, meta.cols), meta.epsg


def valid(cells: DataFrame, nodata: float | None) -> DataFrame:
    """Cells with a value; missing ones are left out."""
    z = F.col("z")
    ok = z.isNotNull() & ~F.isnan(z)
    return cells.where(ok if nodata is None else ok & (z != F.lit(float(nodata))))


def write_cells(cells: DataFrame, grid: Grid, path: str, nodata: float | None = None, epsg: int | None = None) -> None:
    cells.select("row", "col", "z").write.parquet(f"{path}/cells")
    row = [(grid.x0, grid.y0, grid.res, grid.rows, grid.cols, nodata, epsg)]
    cells.sparkSession.createDataFrame(row, "x0 double, y0 double, res double, rows int, cols int, nodata double, epsg int").write.parquet(f"{path}/meta")


def read_geotiff(spark: SparkSession, path: str, block_rows: int = 256) -> tuple[DataFrame, Grid, int | None]:
    """The same from a GeoTIFF on a mounted file system, a block of rows per task; needs rasterio."""
    if rasterio is None:
        raise RuntimeError("GeoTIFF needs rasterio, which is not installed; use Parquet cells")
    with rasterio.open(path) as f:
        grid = Grid(f.transform.c, f.transform.f, f.transform.a, f.height, f.width)
        nodata, epsg = f.nodata, f.crs.to_epsg() if f.crs else None

    def work(batches):
        import numpy as np
        import pyarrow as pa

        with rasterio.open(path) as f:
            for b in batches:
                for first in b.column("id").to_pylist():
                    n = min(block_rows, grid.rows - first)
                    z = f.read(1, window=((first, first + n), (0, grid.cols))).astype(np.float64).reshape(-1)
                    k = np.arange(len(z))
                    yield pa.RecordBatch.from_arrays([pa.array(first + k // grid.cols), pa.array(k % grid.cols), pa.array(z)], names=["row", "col", "z"])

    starts = spark.range(0, grid.rows, block_rows, max(1, -(-grid.rows // block_rows)))
    return valid(starts.mapInArrow(work, "row long, col long, z double"), nodata), grid, epsg
