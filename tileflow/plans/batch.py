"""Queries on batch rendering, expiry and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.functions import address as A
from tileflow.functions import web as W
from tileflow.operators import batch as B
from tileflow.operators import freshness as fr
from tileflow.operators import render
from tileflow.operators.freshness import KEY
from tileflow.plans.registry import query
from tileflow.plans.serving import stats
from tileflow.sources import tables
from tileflow.sources.views import NOW, Views

C = F.col


@query(r"SELECT req_id, x, y, z FROM (SELECT req_id, TRY_CAST(string_split(line, ' ')[1] AS BIGINT) AS x, TRY_CAST(string_split(line, ' ')[2] AS BIGINT) AS y, TRY_CAST(string_split(line, ' ')[3] AS INT) AS z FROM list_lines) WHERE x IS NOT NULL")
def list_xyz(v: Views) -> DataFrame:
    return B.parse_xyz(v.list_lines).select("req_id", "x", "y", "z")


@query("SELECT req_id, z, x, y FROM (SELECT req_id, TRY_CAST(string_split(line, '/')[1] AS INT) AS z, TRY_CAST(string_split(line, '/')[2] AS BIGINT) AS x, TRY_CAST(string_split(line, '/')[3] AS BIGINT) AS y FROM expire_lines) WHERE x IS NOT NULL")
def list_zxy(v: Views) -> DataFrame:
    return B.parse_zxy(v.expire_lines).select("req_id", "z", "x", "y")


_PYRAMID = """
l AS (SELECT x, y, z FROM tile_requests WHERE req_id % 97 <> 0),
d AS (SELECT DISTINCT CASE WHEN z > 18 THEN x >> (z - 18) ELSE x << (18 - z) END AS x, CASE WHEN z > 18 THEN y >> (z - 18) ELSE y << (18 - z) END AS y FROM l),
e AS (SELECT DISTINCT k AS z, ((x >> (18 - k)) // 8) * 8 AS mx, ((y >> (18 - k)) // 8) * 8 AS my FROM d, (SELECT CAST(unnest(range(3, 19)) AS INT) AS k))"""


def expanded(v: Views) -> DataFrame:
    return B.expand(B.parse_zxy(v.expire_lines), 0, 18)


@query(f"WITH {_PYRAMID} SELECT z, mx, my FROM e")
def expire_expand(v: Views) -> DataFrame:
    return expanded(v)


_ACTION = f"WITH {_PYRAMID}, a AS (SELECT e.z, e.mx, e.my, CASE WHEN coalesce(size, -1) <= 0 THEN 'ignore' WHEN e.z >= 18 THEN 'delete' WHEN e.z >= 15 THEN 'touch' ELSE 'render' END AS action FROM e LEFT JOIN (SELECT * FROM tile_cache WHERE style = 'view') c ON e.z = c.z AND e.mx = c.mx AND e.my = c.my)"


def actions(v: Views) -> DataFrame:
    cache = v.tile_cache.where("style = 'view'").select("z", "mx", "my", "size")
    return expanded(v).join(cache, ["z", "mx", "my"], "left").select("z", "mx", "my", B.expire_action(C("size"), C("z"), 18, 15, True).alias("action"))


@query(f"{_ACTION} SELECT z, mx, my, action FROM a")
def expire_actions(v: Views) -> DataFrame:
    return actions(v)


@query(f"{_ACTION} SELECT (SELECT count(*) FROM l) AS n_read, count(*) AS n_expanded, count(*) FILTER (WHERE action = 'delete') AS n_deleted, count(*) FILTER (WHERE action = 'touch') AS n_touched, count(*) FILTER (WHERE action = 'render') AS n_rendered, count(*) FILTER (WHERE action = 'ignore') AS n_ignored FROM a")
def expire_totals(v: Views) -> DataFrame:
    read = B.parse_zxy(v.expire_lines).agg(F.count("*").alias("n_read"))
    n = lambda a: F.count_if(C("action") == a)
    done = actions(v).agg(F.count("*").alias("n_expanded"), n("delete").alias("n_deleted"), n("touch").alias("n_touched"), n("render").alias("n_rendered"), n("ignore").alias("n_ignored"))
    return read.join(F.broadcast(done))


@query("""
WITH g AS (SELECT area, CAST(unnest(range(min_zoom, min_zoom + 4)) AS INT) AS z FROM areas), x AS (SELECT area, z, unnest(range(0, CAST(pow(2, z) AS BIGINT), 8)) AS x FROM g)
SELECT area, z, x, unnest(range(0, CAST(pow(2, z) AS BIGINT), 8)) AS y FROM x
""")
def render_grid(v: Views) -> DataFrame:
    """All metatiles of the four zooms that each area begins with."""
    return B.grids(v.areas.select("area", "min_zoom", (C("min_zoom") + 3).alias("max_zoom")))


_X, _Y = "CAST(floor(({0} + 180.0) / 360.0 * pow(2.0, z)) AS BIGINT)", "CAST(floor((1.0 - ln(tan({0} * pi() / 180.0) + 1.0 / cos({0} * pi() / 180.0)) / pi()) / 2.0 * pow(2.0, z)) AS BIGINT)"


@query(f"""
WITH g AS (SELECT *, CAST(unnest(range(min_zoom, max_zoom + 1)) AS INT) AS z FROM areas), b AS (SELECT area, z, {_X.format("min_lon")} AS x0, {_X.format("max_lon")} AS x1, {_Y.format("max_lat")} AS y0, {_Y.format("min_lat")} AS y1 FROM g),
x AS (SELECT area, z, y0, y1, unnest(range(x0, CASE WHEN x1 <> 0 THEN x1 ELSE x1 + 1 END, 8)) AS x FROM b)
SELECT area, z, x, unnest(range(y0, y1 + 1, 8)) AS y FROM x
""")
def render_grid_bbox(v: Views) -> DataFrame:
    """The metatiles of each area's box, stepped from its own corner."""
    return B.grids(v.areas)


@query("""
WITH c AS (SELECT *, pow(2.0, z) * 256.0 AS c FROM (SELECT *, CAST(unnest(range(0, 21)) AS INT) AS z FROM areas)),
p AS (SELECT area, z, round(c / 2.0 + min_lon * (c / 360.0)) AS px0, round(c / 2.0 + max_lon * (c / 360.0)) AS px1,
  round(c / 2.0 - 0.5 * ln((1.0 + sin(max_lat * pi() / 180.0)) / (1.0 - sin(max_lat * pi() / 180.0))) * (c / (2.0 * pi()))) AS py0,
  round(c / 2.0 - 0.5 * ln((1.0 + sin(min_lat * pi() / 180.0)) / (1.0 - sin(min_lat * pi() / 180.0))) * (c / (2.0 * pi()))) AS py1 FROM c)
SELECT area, z, CAST((floor(px1 / 256) - floor(px0 / 256) + 1) * (floor(py1 / 256) - floor(py0 / 256) + 1) AS BIGINT) AS n_tiles FROM p
""")
def bbox_tile_count(v: Views) -> DataFrame:
    """Tiles of each area's box at every zoom, as the benchmark counts them."""
    z = v.areas.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(20))))
    px0, py0 = A.ll_to_pixel(C("min_lon"), C("max_lat"), C("z"))
    px1, py1 = A.ll_to_pixel(C("max_lon"), C("min_lat"), C("z"))
    across = lambda a, b: F.floor(b / 256) - F.floor(a / 256) + 1
    return z.select("area", "z", (across(px0, px1) * across(py0, py1)).cast("long").alias("n_tiles"))


@query("SELECT req_id, size < 0 OR mtime < planet_ts OR req_id % 10 = 0 AS needed FROM tile_stats WHERE size < 0 OR mtime < planet_ts OR req_id % 10 = 0")
def needs_render(v: Views) -> DataFrame:
    """Missing or expired tiles, or any that a user forces."""
    need = (C("size") < 0) | (C("mtime") < C("planet_ts")) | (C("req_id") % 10 == 0)
    return stats(v).where(need).select("req_id", need.alias("needed"))


@query("SELECT count(*) FILTER (WHERE size < 0 OR mtime < planet_ts) AS n_render, 64 * count(*) FILTER (WHERE size < 0 OR mtime < planet_ts) AS n_tiles, count(*) AS n_all FROM tile_stats")
def list_totals(v: Views) -> DataFrame:
    n = F.count_if((C("size") < 0) | (C("mtime") < C("planet_ts")))
    return stats(v).agg(n.alias("n_render"), (n * 64).alias("n_tiles"), F.count("*").alias("n_all"))


@query("SELECT c.style, z, mx, my FROM tile_cache c LEFT JOIN planet_times p ON p.style = c.style WHERE mtime < coalesce(p.planet_ts, (SELECT planet_ts FROM planet_times WHERE style = '*'))")
def stale_scan(v: Views) -> DataFrame:
    return fr.with_planet_time(v.tile_cache, v.planet_times, NOW).where("planet_ts > mtime").select("style", "z", "mx", "my")


@query("SELECT req_id FROM tile_requests r WHERE NOT EXISTS (SELECT 1 FROM tile_cache c WHERE c.style = r.style AND c.z = r.z AND c.mx = r.mx AND c.my = r.my)")
def missing_tiles(v: Views) -> DataFrame:
    return v.tile_requests.join(v.tile_cache.select(*KEY), KEY, "left_anti").select("req_id")


@query("SELECT req_id FROM tile_requests r WHERE EXISTS (SELECT 1 FROM tile_cache c WHERE c.style = r.style AND c.z = r.z AND c.mx = r.mx AND c.my = r.my)")
def present_tiles(v: Views) -> DataFrame:
    return v.tile_requests.join(v.tile_cache.select(*KEY), KEY, "left_semi").select("req_id")


@query("SELECT r.req_id, l.layer_no FROM tile_requests r JOIN layers l USING (style)")
def render_map_join(v: Views) -> DataFrame:
    return v.tile_requests.join(v.layers.select("style", "layer_no"), "style").select("req_id", "layer_no")


@query("SELECT req_id, style, 'NotDone' AS reply FROM tile_requests WHERE style NOT IN (SELECT style FROM layers)")
def unknown_style(v: Views) -> DataFrame:
    """Requests for a style no map has; they are answered, unlike in a queue that never lets go of them."""
    return v.tile_requests.join(v.layers.select("style"), "style", "left_anti").select("req_id", "style", F.lit("NotDone").alias("reply"))


@query("SELECT style, max(layer_no) AS layer_no FROM many_layers GROUP BY style")
def config_lookup(v: Views) -> DataFrame:
    """A map's name finds its last section."""
    return v.many_layers.groupBy("style").agg(F.max("layer_no").alias("layer_no"))


@query("SELECT layer_no AS ordinal, style, baseuri FROM many_layers UNION ALL SELECT layer_no + (SELECT max(layer_no) + 1 FROM many_layers), style, concat('/vhost', baseuri) FROM many_layers WHERE layer_no % 4 = 0")
def layer_union(v: Views) -> DataFrame:
    """Layers of the base server first, then those of the virtual host."""
    last = v.many_layers.agg((F.max("layer_no") + 1).alias("after"))  # one row
    over = v.many_layers.where("layer_no % 4 = 0").join(F.broadcast(last)).select((C("layer_no") + C("after")).alias("ordinal"), "style", F.concat(F.lit("/vhost"), C("baseuri")).alias("baseuri"))
    return v.many_layers.select(C("layer_no").alias("ordinal"), "style", "baseuri").unionByName(over)


@query("SELECT style, count(*) AS n FROM many_layers GROUP BY style HAVING count(*) > 1")
def dup_sections(v: Views) -> DataFrame:
    """Names of maps that several sections have."""
    return v.many_layers.groupBy("style").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT req_id, unnest(string_split('de,en,_', ',')) AS token FROM tile_requests")
def token_explode(v: Views) -> DataFrame:
    return v.tile_requests.select("req_id", F.explode(F.split(F.lit("de,en,_"), ",")).alias("token"))


_MEMBERS = "m AS (SELECT style, z, mx, my, unnest(range(mx, mx + least(CAST(pow(2, z) AS BIGINT), 8))) AS x FROM tile_cache), t AS (SELECT *, unnest(range(my, my + least(CAST(pow(2, z) AS BIGINT), 8))) AS y FROM m)"


@query(f"WITH {_MEMBERS} SELECT style, z, x, y FROM t")
def metatile_tiles(v: Views) -> DataFrame:
    return B.members(v.tile_cache.select(*KEY)).select("style", "z", "x", "y")


@query(f"WITH {_MEMBERS} SELECT concat('http://cache.example.org/tiles/', style, '/', z, '/', x, '/', y, '.png') AS url FROM t")
def purge_urls(v: Views) -> DataFrame:
    s = lambda c: C(c).cast("string")
    return B.members(v.tile_cache.select(*KEY)).select(F.concat(F.concat_ws("/", F.lit("http://cache.example.org/tiles"), "style", s("z"), s("x"), s("y")), F.lit(".png")).alias("url"))


@query("SELECT req_id FROM (SELECT req_id, row_number() OVER (PARTITION BY style ORDER BY req_id) AS n FROM tile_requests) WHERE n % 100 = 0")
def progress_samples(v: Views) -> DataFrame:
    """Every hundredth item of each style's list, as progress is reported."""
    n = fr.numbered(v.tile_requests.select("req_id", "style"), "style", "req_id")
    return n.where("arrival % 100 = 0").select("req_id")


@query("SELECT x, y, z, data, CASE WHEN x % 7 = 3 THEN NULL ELSE date_trunc('second', created_at) END AS created_at FROM tiles_table")
def tiles_table(v: Views) -> DataFrame:
    """Rows of a SQL table whose times are texts, a seventh of them no times."""
    text = F.when(C("x") % 7 == 3, "soon").otherwise(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    return v.tiles_table.select("x", "y", "z", "data", tables.parsed_time(text).alias("created_at"))


@query("SELECT concat(z, '/', x, '/', y, '.png') AS path, created_at AS mtime, octet_length(encode(data)) AS n_bytes FROM tiles_table WHERE length(data) > 0")
def export_paths(v: Views) -> DataFrame:
    """Where an exported tile goes, with the time it gets; empty tiles are skipped."""
    return tables.exported(v.tiles_table).select("path", "mtime", F.length("data").cast("long").alias("n_bytes"))


_ACROSS = "least(CAST(pow(2, z) AS BIGINT), 8)"


@query(f"SELECT style, z, mx, my, 532 + CAST(sum(length(concat(style, '/', z, '/', mx + i, '/', my + j))) AS BIGINT) AS size FROM (SELECT *, unnest(range({_ACROSS})) AS j FROM (SELECT *, unnest(range({_ACROSS})) AS i FROM tile_cache)) GROUP BY style, z, mx, my")
def rendered(v: Views) -> DataFrame:
    """The metatiles of the store rendered again by the default renderer."""
    out = render.rendered(v.tile_cache.select(*KEY))
    return out.select(*KEY, F.length("blob").cast("long").alias("size"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 86400 WHEN 1 THEN date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 86400 WHEN 2 THEN event_id * 1000 END AS planet_s FROM events
""")
def planet_override(v: Views) -> DataFrame:
    """dd/mm/yyyy, dd/mm/yy, seconds and nonsense."""
    i = C("event_id") % 4
    text = F.when(i == 0, F.date_format("ts", "dd/MM/yyyy")).when(i == 1, F.date_format("ts", "dd/MM/yy")).when(i == 2, (C("event_id") * 1000).cast("string")).otherwise("soon")
    return v.events.select("event_id", W.planet_override(text).alias("planet_s"))
