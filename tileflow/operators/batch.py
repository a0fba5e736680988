"""Batch tools: grids, zoom pyramids, expiry and stale scans."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tileflow.constants import MAX_ZOOM, METATILE
from tileflow.functions import address as A

INT = r"\s*([-+]?\d+)"


def parse_xyz(lines: DataFrame) -> DataFrame:
    """"x y z" lines -> x, y, z; lines that are not three numbers are dropped."""
    part = lambda i: F.regexp_extract("line", rf"^{INT}\s+{INT}\s+{INT}", i).try_cast("bigint")
    return lines.withColumns({"x": part(1), "y": part(2), "z": part(3).cast("int")}).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").drop("line")


def parse_zxy(lines: DataFrame) -> DataFrame:
    """"z/x/y" lines -> z, x, y."""
    part = lambda i: F.regexp_extract("line", rf"^{INT}/{INT}/{INT}", i).try_cast("bigint")
    return lines.withColumns({"z": part(1).cast("int"), "x": part(2), "y": part(3)}).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").drop("line")


def check_range(min_zoom: int, max_zoom: int, box: dict[str, float | None], tiles: dict[str, int | None]) -> None:
    """Refuse argument combinations that name no grid; half-given lon/lat boxes are ignored, as users expect."""
    lonlat = all(box.get(k) is not None for k in ("min_lon", "min_lat", "max_lon", "max_lat"))
    by_tile = any(tiles.get(k) is not None for k in ("min_x", "min_y", "max_x", "max_y"))
    if not 0 <= min_zoom <= max_zoom <= MAX_ZOOM:
        raise ValueError("zooms must be 0 <= min <= max <= 20")
    if lonlat and by_tile:
        raise ValueError("a lon/lat box and tile bounds exclude each other")
    if lonlat and (box["max_lat"] < box["min_lat"] or box["max_lon"] < box["min_lon"]):
        raise ValueError("the box is empty")
    if by_tile and min_zoom != max_zoom:
        raise ValueError("tile bounds need one zoom")
    for lo, hi in (("min_x", "max_x"), ("min_y", "max_y")):
        if tiles.get(lo) is not None and tiles.get(hi) is not None and tiles[hi] < tiles[lo]:
            raise ValueError(f"{hi} is below {lo}")
    if by_tile and any((tiles.get(k) or 0) > (1 << min_zoom) - 1 for k in ("min_x", "min_y", "max_x", "max_y")):
        raise ValueError("tile bounds exceed the zoom")


def grid(spark: SparkSession, min_zoom: int, max_zoom: int, box: dict[str, float | None] | None = None, tiles: dict[str, int | None] | None = None, parallelism: int = 64) -> DataFrame:
    """(z, x, y) of metatiles to render: ``grids`` of one area given by options."""
    box, tiles = box or {}, tiles or {}
    check_range(min_zoom, max_zoom, box, tiles)
    lit = lambda d, k, t: F.lit(d.get(k)).cast(t).alias(k)
    ends = [lit(box, k, "double") for k in BOX] + [lit(tiles, k, "long") for k in TILES]
    area = spark.range(1, numPartitions=1).select(F.lit(min_zoom).alias("min_zoom"), F.lit(max_zoom).alias("max_zoom"), *ends)
    return grids(area, parallelism).select("z", "x", "y")


BOX, TILES = ("min_lon", "max_lon", "min_lat", "max_lat"), ("min_x", "max_x", "min_y", "max_y")


def grids(areas: DataFrame, parallelism: int = 64) -> DataFrame:
    """areas(.., min_zoom, max_zoom[, box][, tiles]) -> (.., z, x, y) of the metatiles to render of each. Rows of x are dealt out before y is
    expanded, so a deep zoom spreads over tasks.

    A lon/lat box steps from its own corner, unaligned, and leaves out the last column but not the last row; an area without one
    goes by its tile bounds, null ones being those of the zoom.
    """
    have = lambda k, t: F.col(k) if k in areas.columns else F.lit(None).cast(t)
    rest = [c for c in areas.columns if c not in ("min_zoom", "max_zoom", *BOX, *TILES)]
    z = areas.withColumn("z", F.explode(F.sequence("min_zoom", "max_zoom")))
    zz, last = F.col("z"), F.pow(F.lit(2.0), F.col("z")).cast("long") - 1
    lon0, lon1, lat0, lat1 = (have(k, "double") for k in BOX)
    boxed = lon0.isNotNull() & lon1.isNotNull() & lat0.isNotNull() & lat1.isNotNull()
    pick = lambda k, d: F.coalesce(have(k, "long"), d)
    end, none = A.lon_to_x(lon1, zz), F.lit(0).cast("long")
    x0, x1 = F.when(boxed, A.lon_to_x(lon0, zz)).otherwise(pick("min_x", none)), F.when(boxed, F.when(end != 0, end - 1).otherwise(end)).otherwise(pick("max_x", last))
    y0, y1 = F.when(boxed, A.lat_to_y(lat1, zz)).otherwise(pick("min_y", none)), F.when(boxed, A.lat_to_y(lat0, zz)).otherwise(pick("max_y", last))
    step = F.lit(METATILE).cast("long")
    columns = z.select(*rest, "z", y0.alias("y0"), y1.alias("y1"), F.when(x1 >= x0, F.sequence(x0, x1, step)).alias("xs")).select(*rest, "z", "y0", "y1", F.explode("xs").alias("x"))
    return columns.repartition(parallelism, *rest, "z", "x").where("y1 >= y0").select(*rest, "z", "x", F.explode(F.sequence(F.col("y0"), F.col("y1"), step)).alias("y"))


def expand(tiles: DataFrame, min_zoom: int, max_zoom: int, full_cover: bool = False) -> DataFrame:
    """Tiles -> the distinct metatiles above them, from max_zoom up to min_zoom (3 at least; above that all share one).

    Tiles are moved to max_zoom first: down by their top-left descendant only, or with ``full_cover`` by all. They are
    reduced to metatiles and made distinct before the pyramid is expanded, which keeps the second shuffle small.
    """
    min_zoom = max(min_zoom, 3)
    ok = tiles.where(A.valid_xyz(F.col("x"), F.col("y"), F.col("z")))
    to = F.lit(max_zoom)
    if full_cover:
        span = F.pow(F.lit(2.0), F.greatest(to - F.col("z"), F.lit(0))).cast("long")
        base = lambda c: F.when(F.col("z") > max_zoom, A.relevel(F.col(c), F.col("z"), to)).otherwise(F.col(c) * span)
        wide = F.when(F.col("z") > max_zoom, F.lit(1).cast("long")).otherwise(span)
        ok = ok.select(base("x").alias("bx"), base("y").alias("by"), wide.alias("w")).withColumn("x", F.explode(F.sequence(F.col("bx"), F.col("bx") + F.col("w") - 1, F.least(F.col("w"), F.lit(8).cast("long")))))
        ok = ok.withColumn("y", F.explode(F.sequence(F.col("by"), F.col("by") + F.col("w") - 1, F.least(F.col("w"), F.lit(8).cast("long")))))
        moved = ok.select("x", "y")
    else:
        moved = ok.select(A.relevel(F.col("x"), F.col("z"), to).alias("x"), A.relevel(F.col("y"), F.col("z"), to).alias("y"))
    meta = moved.select(A.metatile_origin(F.col("x")).alias("x"), A.metatile_origin(F.col("y")).alias("y")).distinct()
    zs = meta.withColumn("z", F.explode(F.array(*[F.lit(z) for z in range(min_zoom, max_zoom + 1)]))) if max_zoom >= min_zoom else meta.withColumn("z", F.lit(None).cast("int")).where("false")
    up = lambda c: A.metatile_origin(A.relevel(F.col(c), to, F.col("z")))
    return zs.select("z", up("x").alias("mx"), up("y").alias("my")).distinct()


def expire_action(size: Column, z: Column, delete_from: int | None, touch_from: int | None, render: bool) -> Column:
    """What happens to an expired metatile that the store may hold."""
    out = F.lit("render" if render else "none")
    if touch_from is not None:
        out = F.when(z >= touch_from, "touch").otherwise(out)
    if delete_from is not None:
        out = F.when(z >= delete_from, "delete").otherwise(out)
    return F.when(F.coalesce(size, F.lit(-1)) > 0, out).otherwise("ignore")


def members(metatiles: DataFrame) -> DataFrame:
    """Metatiles -> their tiles (at most 8 x 8, fewer at low zooms)."""
    n = F.least(F.pow(F.lit(2.0), F.col("z")).cast("long"), F.lit(METATILE).cast("long"))
    m = metatiles.withColumn("x", F.explode(F.sequence(F.col("mx"), F.col("mx") + n - 1)))
    return m.withColumn("y", F.explode(F.sequence(F.col("my"), F.col("my") + n - 1)))


def in_order(metatiles: DataFrame, expiry: bool = False) -> DataFrame:
    """The order in which lists are worked off: zoom by zoom upwards, for expiry downwards. Sorted by ranges, so over many tasks."""
    return metatiles.orderBy(F.desc("z") if expiry else F.asc("z"), *[c for c in metatiles.columns if c != "z"])


def wait_for_load(load: Callable[[], float], limit: float, pause: Callable[[float], None] = time.sleep, every: float = 5.0) -> int:
    """Clients that submit work hold back while the load is at its limit or above; returns how often they waited."""
    waits = 0
    while load() >= limit:
        pause(every)
        waits += 1
    return waits
