"""Queries on tile addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.constants import PROJECTIONS
from tileflow.functions import address as A
from tileflow.plans.registry import query
from tileflow.sources import stores
from tileflow.sources.views import Views

C = F.col
TILE_DIR = "/var/cache/tiles"


@query("SELECT req_id, x - x % 8 AS mx, y - y % 8 AS my FROM tile_requests")
def metatile_align(v: Views) -> DataFrame:
    return v.tile_requests.select("req_id", A.metatile_origin(C("x")).alias("mx"), A.metatile_origin(C("y")).alias("my"))


@query("SELECT req_id, (x % 8) * 8 + y % 8 AS slot FROM tile_requests")
def metatile_slot(v: Views) -> DataFrame:
    return v.tile_requests.select("req_id", A.metatile_slot(C("x"), C("y")).alias("slot"))


_PATH = "concat('/var/cache/tiles/', style, '/', z, " + ", ".join(f"'/', ((mx >> {4 * i}) & 15) * 16 + ((my >> {4 * i}) & 15)" for i in (4, 3, 2, 1, 0)) + ", '.meta')"


@query(f"SELECT req_id, {_PATH} AS path FROM tile_requests")
def hashed_path(v: Views) -> DataFrame:
    return v.tile_requests.select("req_id", A.hashed_path(F.lit(TILE_DIR), C("style"), C("z"), C("x"), C("y")).alias("path"))


@query(f"""
WITH p AS (SELECT req_id, style AS s, z AS zz, mx, my, CASE WHEN req_id % 13 = 0 THEN 1 WHEN req_id % 17 = 0 THEN 2 WHEN req_id % 19 = 0 THEN 3 ELSE 0 END AS code FROM tile_requests)
SELECT req_id, CASE WHEN code <> 1 THEN s END AS style, CASE WHEN code = 1 THEN NULL WHEN code = 3 THEN 21 ELSE zz END AS z,
  CASE WHEN code IN (0, 3) THEN mx END AS x, CASE WHEN code IN (0, 3) THEN my END AS y, code FROM p
""")
def path_parse(v: Views) -> DataFrame:
    """Paths of all requests, some with a foreign prefix, a number over 255 or a zoom beyond the last."""
    good = A.hashed_path(F.lit(TILE_DIR), C("style"), C("z"), C("x"), C("y"))
    over = F.concat(F.regexp_replace(good, r"/\d+\.meta$", "/256.meta"))
    deep = A.hashed_path(F.lit(TILE_DIR), C("style"), F.lit(21), C("x"), C("y"))
    path = F.when(C("req_id") % 13 == 0, F.concat(F.lit("/elsewhere"), good)).when(C("req_id") % 17 == 0, over).when(C("req_id") % 19 == 0, deep).otherwise(good)
    parsed = A.parse_path(TILE_DIR, C("path"))
    return v.tile_requests.select("req_id", path.alias("path")).select("req_id", *[c.alias(k) for k, c in parsed.items()])


@query("""
SELECT req_id, concat(style, '/', mx, '/', my, '/', z, CASE WHEN req_id % 3 = 0 THEN '.de.meta' ELSE '.meta' END) AS memcached_key,
  concat(style, '/', z, '/', mx, '/', my, CASE WHEN req_id % 3 = 0 THEN '.de.meta' ELSE '.meta' END) AS rados_key, concat(z, '/', x, '/', y, '.png') AS proxy_path FROM tile_requests
""")
def store_keys(v: Views) -> DataFrame:
    options = F.when(C("req_id") % 3 == 0, "de").otherwise("")
    return v.tile_requests.select("req_id", *[c.alias(k) for k, c in A.store_keys(C("style"), C("z"), C("x"), C("y"), options).items()])


@query("""
SELECT point_id, z, CAST(floor((lon + 180.0) / 360.0 * pow(2.0, z)) AS BIGINT) AS x,
  CAST(floor((1.0 - ln(tan(lat * pi() / 180.0) + 1.0 / cos(lat * pi() / 180.0)) / pi()) / 2.0 * pow(2.0, z)) AS BIGINT) AS y
FROM geo_points, (SELECT unnest([0, 6, 12, 18]) AS z)
""")
def lonlat_tile(v: Views) -> DataFrame:
    p = v.geo_points.withColumn("z", F.explode(F.array(*map(F.lit, (0, 6, 12, 18)))))
    return p.select("point_id", "z", A.lon_to_x(C("lon"), C("z")).alias("x"), A.lat_to_y(C("lat"), C("z")).alias("y"))


@query("""
WITH p AS (SELECT *, pow(2.0, 12) * 256.0 AS c, least(greatest(sin(lat * pi() / 180.0), -0.9999), 0.9999) AS f FROM geo_points)
SELECT point_id, CAST(round(c / 2.0 + lon * (c / 360.0)) AS BIGINT) AS px, CAST(round(c / 2.0 - 0.5 * ln((1.0 + f) / (1.0 - f)) * (c / (2.0 * pi()))) AS BIGINT) AS py FROM p
""")
def ll_to_pixel(v: Views) -> DataFrame:
    px, py = A.ll_to_pixel(C("lon"), C("lat"), F.lit(12))
    return v.geo_points.select("point_id", px.alias("px"), py.alias("py"))


@query("""
WITH p AS (SELECT point_id, (point_id * 997) % 1048576 AS px, (point_id * 1009) % 1048576 AS py, pow(2.0, 12) * 256.0 AS c FROM geo_points)
SELECT point_id, round((px - c / 2.0) / (c / 360.0), 6) AS lon, round((2.0 * atan(exp((py - c / 2.0) / -(c / (2.0 * pi())))) - 0.5 * pi()) * 180.0 / pi(), 6) AS lat FROM p
""")
def pixel_to_ll(v: Views) -> DataFrame:
    lon, lat = A.pixel_to_ll(C("point_id") * 997 % 1048576, C("point_id") * 1009 % 1048576, F.lit(12))
    return v.geo_points.select("point_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


_KIND = "CASE srs_no WHEN 1 THEN 'plate_carree' WHEN 2 THEN 'british_grid' ELSE 'mercator' END"
_BOUNDS = ", ".join(
    f"CASE {_KIND} " + " ".join(f"WHEN '{k}' THEN CAST({p[i]} AS {'DOUBLE' if i < 4 else 'INT'})" for k, p in PROJECTIONS.items()) + f" END AS {n}"
    for i, n in enumerate(("bound_x0", "bound_y0", "bound_x1", "bound_y1", "aspect_x", "aspect_y"))
)


@query(f"WITH s AS (SELECT s_suppkey, CAST(s_suppkey % 4 AS INT) AS srs_no FROM supplier) SELECT s_suppkey AS layer, srs_no, {_BOUNDS} FROM s")
def projection_lookup(v: Views) -> DataFrame:
    """Bounds of each layer by the projection of its map."""
    r = v.supplier.select(C("s_suppkey").alias("layer"), (C("s_suppkey") % 4).cast("int").alias("srs_no")).join(v.srs_cases, "srs_no")
    return r.select("layer", "srs_no", *[c.alias(k) for k, c in A.projection(C("srs")).items()])


@query(f"""
WITH s AS (SELECT srs_no, {_BOUNDS} FROM srs_cases), r AS (SELECT *, pow(2.0, z) AS n FROM tile_requests JOIN s ON srs_no = req_id % 4),
t AS (SELECT *, aspect_x * n AS nx, aspect_y * n AS ny, least(8.0, aspect_x * n) AS tx, least(8.0, aspect_y * n) AS ty, bound_x1 - bound_x0 AS w, bound_y1 - bound_y0 AS h FROM r)
SELECT req_id, bound_x0 + w * (mx / nx) AS minx, bound_y1 - h * ((my + ty) / ny) AS miny, bound_x0 + w * ((mx + tx) / nx) AS maxx, bound_y1 - h * (my / ny) AS maxy, CAST(tx AS INT) AS tiles_x, CAST(ty AS INT) AS tiles_y FROM t
""")
def tile_bbox(v: Views) -> DataFrame:
    p = v.srs_cases.select("srs_no", *[c.alias(k) for k, c in A.projection(C("srs")).items()])
    r = v.tile_requests.join(F.broadcast(p), C("srs_no") == C("req_id") % 4)  # four rows
    box = A.tile_bounds({n: C(n) for n in ("bound_x0", "bound_y0", "bound_x1", "bound_y1", "aspect_x", "aspect_y")}, C("mx"), C("my"), C("z"))
    return r.select("req_id", *[c.alias(k) for k, c in box.items()])


@query("""
SELECT req_id, CASE WHEN z > 12 THEN x >> (z - 12) ELSE x << (12 - z) END AS x, CASE WHEN z > 12 THEN y >> (z - 12) ELSE y << (12 - z) END AS y FROM tile_requests
""")
def zoom_relevel(v: Views) -> DataFrame:
    return v.tile_requests.select("req_id", A.relevel(C("x"), C("z"), F.lit(12)).alias("x"), A.relevel(C("y"), C("z"), F.lit(12)).alias("y"))


@query("""
SELECT req_id, ((CAST(list_sum(list_transform(string_split(style, ''), lambda c: ascii(c))) AS BIGINT) & 511) * 4503599627370496 + z * 281474976710656 + (mx & 16777215) * 16777216 + (my & 16777215)) % 2213 AS bucket
FROM tile_requests
""")
def queue_hash(v: Views) -> DataFrame:
    return v.tile_requests.select("req_id", A.queue_hash(C("style"), C("z"), C("mx"), C("my")).alias("bucket"))


@query("SELECT req_id, z BETWEEN 0 AND 20 AND x BETWEEN 0 AND CAST(pow(2, z) AS BIGINT) - 1 AND y BETWEEN 0 AND CAST(pow(2, z) AS BIGINT) - 1 AS valid FROM shifted")
def valid_xyz(v: Views) -> DataFrame:
    return v.shifted.select("req_id", A.valid_xyz(C("x"), C("y"), C("z")).alias("valid"))


@query("""
SELECT req_id, layer_no, z BETWEEN minzoom AND maxzoom AND x BETWEEN 0 AND CAST(pow(2, z) AS BIGINT) * aspect_x - 1 AND y BETWEEN 0 AND CAST(pow(2, z) AS BIGINT) * aspect_y - 1 AS valid
FROM shifted JOIN layers USING (style)
""")
def valid_xyz_layer(v: Views) -> DataFrame:
    r = v.shifted.join(v.layers, "style")
    ok = A.valid_xyz(C("x"), C("y"), C("z"), aspect_x=C("aspect_x"), aspect_y=C("aspect_y"), minzoom=C("minzoom"), maxzoom=C("maxzoom"))
    return r.select("req_id", "layer_no", ok.alias("valid"))


@query("SELECT req_id, z, x, y FROM tile_requests WHERE z BETWEEN 5 AND 15")
def zoom_filter(v: Views) -> DataFrame:
    return v.tile_requests.where(C("z").between(5, 15)).select("req_id", "z", "x", "y")


@query("""
SELECT req_id, concat('file://', """ + _PATH + """) AS file_id, concat('memcached:///', style, '/', x, '/', y, '/', z, '.meta') AS memcached_id,
  concat('rados://tiles/', style, '/', z, '/', mx, '/', my, '.meta') AS rados_id, concat('http://proxy/', z, '/', x, '/', y, '.png') AS proxy_id, 'null://' AS null_id, 'Coposite tile' AS composite_id FROM tile_requests
""")
def storage_id(v: Views) -> DataFrame:
    """Where each kind of store says a tile is. The last text is misspelled as users know it."""
    kinds = {"file": stores.FileStore(TILE_DIR), "memcached": stores.TableStore("memcached", ""), "rados": stores.TableStore("rados", "", "tiles"), "proxy": stores.ProxyStore("proxy"), "null": stores.NullStore(), "composite": stores.CompositeStore(None, "", None, "")}
    return v.tile_requests.select("req_id", *[s.place().alias(f"{kind}_id") for kind, s in kinds.items()])
