"""Derived input views: tile requests, a tile store and their dimensions, from the base tables.

Each view is one SQL text that Spark and a SQL oracle read alike. ``Views`` gives them as
lazy DataFrames over one directory of Parquet tables; ``with_views`` puts the texts that a
query names before it as common table expressions.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

NOW = "2024-02-01 00:00:00"

VIEWS = {
    "tile_requests": """
SELECT *, x - x % 8 AS mx, y - y % 8 AS my,
       concat('/tiles/', style, '/', CAST(z AS STRING), '/', CAST(x AS STRING), '/', CAST(y AS STRING), '.png') AS url
FROM (SELECT event_id AS req_id, ts, user_id AS client_id,
        concat('10.', CAST(CAST(floor(user_id / 256) AS BIGINT) AS STRING), '.', CAST(user_id % 256 AS STRING), '.1') AS client_ip,
        event_type AS style, CAST(event_id % 21 AS INT) AS z,
        (event_id * 2654435761) % CAST(pow(2, event_id % 21) AS BIGINT) AS x,
        (event_id * 40503 + user_id * 977) % CAST(pow(2, event_id % 21) AS BIGINT) AS y,
        CASE event_id % 5 WHEN 0 THEN 'RenderPrio' WHEN 1 THEN 'Render' WHEN 2 THEN 'RenderLow' WHEN 3 THEN 'Dirty' ELSE 'RenderBulk' END AS cmd,
        value / 4.0 AS load_avg, (event_id * 7919) % 6000 AS render_ms
      FROM events) e""",
    "tile_cache": """
SELECT style, z, mx, my, min(ts) AS mtime, 532 + 100 * count(*) AS size
FROM tile_requests WHERE req_id % 4 <> 0 GROUP BY style, z, mx, my""",
    "planet_times": """
SELECT * FROM (VALUES ('error', TIMESTAMP '2024-01-20 00:00:00'), ('*', TIMESTAMP '2024-01-10 00:00:00')) AS t(style, planet_ts)""",
    "layers": """
SELECT * FROM (VALUES
  (0, 'click', '/tiles/click/', 0, 20, 1, 1, 'png', 'image/png'),
  (1, 'error', '/tiles/error/', 0, 18, 1, 1, 'png', 'image/png'),
  (2, 'view', '/tiles/view/', 5, 20, 2, 1, 'png', 'image/png'),
  (3, 'signup', '/tiles/signup/', 0, 20, 1, 1, 'jpg', 'image/jpeg'),
  (4, 'fallback', '/tiles/', 0, 20, 1, 1, 'png', 'image/png')
) AS t(layer_no, style, baseuri, minzoom, maxzoom, aspect_x, aspect_y, ext, mime)""",
    "many_layers": """
SELECT s_suppkey AS layer_no, concat('s', CAST(s_suppkey % 40 AS STRING)) AS style, concat('/tiles/s', CAST(s_suppkey AS STRING), '/') AS baseuri, CAST(s_suppkey % 5 AS INT) AS minzoom, CAST(10 + s_suppkey % 11 AS INT) AS maxzoom,
  CAST(1 + s_suppkey % 2 AS INT) AS aspect_x, 1 AS aspect_y, CASE WHEN s_suppkey % 3 = 0 THEN 'jpg' ELSE 'png' END AS ext, CASE WHEN s_suppkey % 3 = 0 THEN 'image/jpeg' ELSE 'image/png' END AS mime
FROM supplier""",
    "config_texts": """
SELECT s_suppkey AS server, concat('[daemon]', chr(10), 'num_threads=', CAST(s_suppkey % 8 + 1 AS STRING), chr(10), '[daemon1]', chr(10), 'num_threads=', CAST(s_suppkey % 5 + 1 AS STRING), chr(10), '[daemon2]', chr(10), '[engine]', chr(10), 'plugins_dir=/usr/lib/engine', chr(10), '[s', CAST(s_suppkey AS STRING),
  ']', chr(10), 'URI=/tiles/s', CAST(s_suppkey AS STRING), CASE WHEN s_suppkey % 2 = 0 THEN '/' ELSE '' END, chr(10), 'XML=/etc/s.xml', chr(10), 'MAXZOOM=', CAST(10 + s_suppkey % 11 AS STRING),
  CASE WHEN s_suppkey % 3 = 0 THEN concat(chr(10), '[labels]', chr(10), 'URI=/labels', chr(10), 'TYPE=jpg image/jpeg', chr(10), 'ASPECTX=2', chr(10), 'PARAMETERIZE_STYLE=language', chr(10), 'SCALE=2.0', chr(10), 'MINZOOM=', CAST(s_suppkey % 5 AS STRING)) ELSE '' END, chr(10)) AS text
FROM supplier""",
    "areas": """
SELECT c_custkey AS area, CAST(c_custkey % 4 AS INT) AS min_zoom, CAST(4 + c_custkey % 8 AS INT) AS max_zoom, (c_custkey * 37 % 35000) / CAST(100 AS DOUBLE) - 178 AS min_lon, (c_custkey * 37 % 35000) / CAST(100 AS DOUBLE) - 177 AS max_lon,
  (c_custkey * 53 % 16000) / CAST(100 AS DOUBLE) - 81 AS min_lat, (c_custkey * 53 % 16000) / CAST(100 AS DOUBLE) - 80 AS max_lat
FROM customer""",
    "expire_lines": """
SELECT req_id, CASE WHEN req_id % 97 = 0 THEN 'z/x/y' ELSE concat(CAST(z AS STRING), '/', CAST(x AS STRING), '/', CAST(y AS STRING)) END AS line
FROM tile_requests""",
    "list_lines": """
SELECT req_id, CASE WHEN req_id % 89 = 0 THEN 'x y z' ELSE concat(CAST(x AS STRING), ' ', CAST(y AS STRING), ' ', CAST(z AS STRING)) END AS line
FROM tile_requests""",
    "counter_polls": """
SELECT poll, z, CAST(sum(n) OVER (PARTITION BY z ORDER BY poll) AS BIGINT) AS n_reads, CAST(sum(us) OVER (PARTITION BY z ORDER BY poll) AS BIGINT) AS dur_us
FROM (SELECT date_trunc('day', ts) AS poll, z, count(*) AS n, sum(render_ms) * 1000 AS us FROM tile_requests GROUP BY 1, 2) d""",
    "geo_points": """
SELECT c_custkey AS point_id, (c_custkey * 37 % 36000) / CAST(100 AS DOUBLE) - 180 AS lon, (c_custkey * 53 % 17000) / CAST(100 AS DOUBLE) - 85 AS lat
FROM customer""",
    "tiles_table": """
SELECT x, y, z, CASE WHEN req_id % 11 = 0 THEN '' ELSE concat(style, CAST(req_id AS STRING)) END AS data, ts AS created_at
FROM tile_requests""",
    "url_cases": """
SELECT req_id, style, CASE WHEN req_id % 41 = 0 THEN '/server_stats' WHEN req_id % 43 = 0 THEN '/metrics' WHEN req_id % 47 = 0 THEN concat('/tiles/', style, '/tile-layer.json')
  WHEN req_id % 37 = 0 THEN concat('/tiles/', style, '/', CAST(z AS STRING), '/', CAST(x AS STRING), '/', CAST(y AS STRING), '.jpg')
  WHEN req_id % 53 = 0 THEN concat('/tiles/', style, '/', CAST(z AS STRING), '/', CAST(x AS STRING), '/-1.png')
  WHEN req_id % 23 = 0 THEN concat(url, '/status') WHEN req_id % 29 = 0 THEN concat(url, '/dirty') WHEN req_id % 31 = 0 THEN concat(url, '/foo')
  WHEN req_id % 59 = 0 THEN '/other' ELSE url END AS url
FROM tile_requests""",
    "shifted": """
SELECT req_id, style, z, CASE WHEN req_id % 11 = 0 THEN x + CAST(pow(2, z) AS BIGINT) ELSE x END AS x, CASE WHEN req_id % 13 = 0 THEN -1 - y ELSE y END AS y
FROM tile_requests""",
    "srs_cases": """
SELECT * FROM (VALUES (0, '+proj=merc +a=6378137 +b=6378137 +lat_ts=0.0'),
  (1, '+proj=eqc +lat_ts=0 +lat_0=0 +lon_0=0 +x_0=0 +y_0=0 +ellps=WGS84 +datum=WGS84 +units=m +no_defs'),
  (2, '+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy +datum=OSGB36 +units=m +no_defs'), (3, '')) AS t(srs_no, srs)""",
    "tile_stats": """
SELECT r.req_id, r.ts, r.client_ip, r.style, r.z, r.x, r.y, r.mx, r.my, r.url, r.cmd, r.load_avg, r.render_ms,
  coalesce(c.size, -1) AS size, c.mtime, coalesce(p.planet_ts, g.planet_ts, TIMESTAMP '2024-01-29 00:00:00') AS planet_ts
FROM tile_requests r LEFT JOIN tile_cache c ON r.style = c.style AND r.z = c.z AND r.mx = c.mx AND r.my = c.my
LEFT JOIN planet_times p ON p.style = r.style LEFT JOIN planet_times g ON g.style = '*'""",
    "tile_states": """
SELECT *, CASE WHEN size < 0 THEN 'missing' WHEN mtime >= planet_ts THEN 'current'
  WHEN mtime > TIMESTAMP '2024-01-15 00:00:00' THEN 'old' ELSE 'veryold' END AS state FROM tile_stats""",
    "outcomes": """
SELECT req_id, z, (req_id * 37) % 5000 AS read_us, coalesce(layer_no, 4) AS layer_no,
  CASE WHEN req_id % 50 = 0 THEN 503 WHEN req_id % 101 = 0 THEN 500 WHEN req_id % 103 = 0 THEN 302 WHEN result = '404' THEN 404 WHEN req_id % 6 = 0 THEN 304 ELSE 200 END AS status,
  CASE WHEN req_id % 50 > 0 THEN counter END AS counter FROM (SELECT s.req_id, s.style, s.z,
  CASE WHEN state = 'missing' AND (load_avg > 50 OR render_ms > 3000) THEN '404' ELSE 'ok' END AS result,
  CASE WHEN state = 'current' THEN 'FRESH' WHEN state = 'missing' AND load_avg > 50 THEN NULL WHEN state <> 'missing' AND load_avg > 16 THEN upper(state)
    WHEN render_ms <= 3000 THEN 'FRESH_RENDER' WHEN state = 'missing' THEN NULL ELSE upper(state) || '_RENDER' END AS counter FROM tile_states s) d LEFT JOIN layers USING (style)""",
    "admitted": """
SELECT req_id, ts, client_id, style, z, x, y, mx, my, cmd, render_ms, wanted, first_req,
  CASE WHEN req_id = first_req AND wanted <> 'Dirty' AND rank_own <= 256 THEN wanted
       WHEN req_id = first_req AND dirty_rank <= 8000 THEN 'Dirty' WHEN req_id = first_req THEN 'Dropped' END AS queue
FROM (SELECT *, sum(CASE WHEN req_id = first_req AND (wanted = 'Dirty' OR rank_own > 256) THEN 1 ELSE 0 END) OVER (ORDER BY req_id) AS dirty_rank
  FROM (SELECT *, sum(CASE WHEN req_id = first_req THEN 1 ELSE 0 END) OVER (PARTITION BY wanted ORDER BY req_id) AS rank_own
    FROM (SELECT *, min(req_id) OVER (PARTITION BY style, z, mx, my) AS first_req,
      CASE cmd WHEN 'RenderPrio' THEN 'Prio' WHEN 'Render' THEN 'Request' WHEN 'RenderLow' THEN 'Low' WHEN 'Dirty' THEN 'Dirty' ELSE 'Bulk' END AS wanted FROM tile_requests) a) b) c""",
}
#: Views that only oracles read: the engine computes these with its own operators.
ORACLE_ONLY = ("tile_stats", "tile_states", "outcomes", "admitted")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _named(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def with_views(sql: str) -> str:
    """The oracle text of a query, after the views it needs in order of definition."""
    need: set[str] = set()
    todo = _named(sql)
    while todo:
        v = todo.pop()
        if v not in need:
            need.add(v)
            todo += [n for n in _named(VIEWS[v]) if n != v]
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in need)
    sql = sql.strip()
    if not ctes:
        return sql
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.upper().startswith(start):
            return f"{start}{ctes},\n{sql[len(start) :]}"
    return f"WITH {ctes}\n{sql}"


class Views:
    """The base tables and derived views of one directory, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS or name in ORACLE_ONLY:
            raise AttributeError(name)
        # zone-less time stamps throughout, whatever the session's time zone
        sql = VIEWS[name].replace("TIMESTAMP '", "TIMESTAMP_NTZ '").replace("date_trunc('day', ts)", "CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ)")
        used = [n for n in (*TABLES, *VIEWS) if n != name and re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]
        for n in used:
            sql = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", sql)
        return self.spark.sql(sql, **{n: getattr(self, n) for n in used})

    @cached_property
    def parallelism(self) -> int:
        return self.spark.sparkContext.defaultParallelism
