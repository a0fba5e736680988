"""Queries on serving: routing, freshness, decisions and headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.functions import web as W
from tileflow.functions.web import ServerConfig
from tileflow.operators import freshness as fr
from tileflow.plans.addressing import _PATH, TILE_DIR
from tileflow.plans.registry import query
from tileflow.sources.stores import FileStore
from tileflow.sources.views import NOW, Views

C = F.col
#: The server of these queries: stale tiles count as very old before 15 January.
CFG = ServerConfig(very_old_us=17 * 86400 * 1_000_000, cache_duration_last_modified_factor=0.1, cache_level_low_zoom=8, cache_level_medium_zoom=14, cache_extended_hostname="extended", cache_extended_duration=2592000)
BULK = CFG.merged({"enable_bulk_mode": True})


def stats(v: Views) -> DataFrame:
    return fr.with_stat(v.tile_requests, v.tile_cache, v.planet_times, NOW)


def states(v: Views) -> DataFrame:
    return fr.with_state(v.tile_requests, v.tile_cache, v.planet_times, NOW, CFG.very_old_us)


@query("SELECT req_id, size, mtime, coalesce(mtime < planet_ts, true) AS expired FROM tile_stats")
def tile_stat(v: Views) -> DataFrame:
    """File store: a missing tile has time 0, and so is expired."""
    return stats(v).select("req_id", "size", "mtime", F.coalesce(C("mtime") < C("planet_ts"), F.lit(True)).alias("expired"))


@query("SELECT req_id, state FROM tile_states")
def tile_state(v: Views) -> DataFrame:
    return states(v).select("req_id", "state")


@query("SELECT z, state, count(*) AS n FROM tile_states GROUP BY z, state")
def tile_state_summary(v: Views) -> DataFrame:
    return states(v).groupBy("z", "state").agg(F.count("*").alias("n"))


@query("SELECT style, max(planet_ts) AS planet_ts FROM tile_stats GROUP BY style")
def planet_time(v: Views) -> DataFrame:
    return fr.with_planet_time(v.tile_requests.select("style").distinct(), v.planet_times, NOW).select("style", "planet_ts")


_IN_TIME = "render_ms <= 3000"
_DECIDE = f"""
d AS (SELECT *, CASE WHEN state = 'current' THEN 'served' WHEN state IN ('old', 'veryold') AND load_avg > 16 THEN 'stale' WHEN state = 'missing' AND load_avg > 50 THEN '404'
    WHEN {_IN_TIME} THEN 'served' WHEN state = 'missing' THEN '404' ELSE 'stale' END AS result,
  CASE WHEN state = 'current' THEN NULL WHEN state IN ('old', 'veryold') AND load_avg > 16 OR state = 'missing' AND load_avg > 50 THEN 'Dirty'
    WHEN state = 'old' THEN 'RenderLow' WHEN state = 'veryold' THEN 'Render' ELSE 'RenderPrio' END AS sent,
  CASE WHEN state = 'current' THEN 'FRESH' WHEN state = 'missing' AND load_avg > 50 THEN NULL WHEN state <> 'missing' AND load_avg > 16 THEN upper(state)
    WHEN {_IN_TIME} THEN 'FRESH_RENDER' WHEN state = 'missing' THEN NULL ELSE upper(state) || '_RENDER' END AS counter FROM tile_states)"""


def decided(v: Views, cfg: ServerConfig = CFG) -> DataFrame:
    s = states(v)
    return s.select("*", *[c.alias(k) for k, c in W.serve_decision(C("state"), C("load_avg"), W.renders_in_time(C("state"), C("render_ms"), cfg), cfg).items()])


@query(f"WITH {_DECIDE} SELECT req_id, state, result, sent, counter FROM d")
def serve_decision(v: Views) -> DataFrame:
    return decided(v).select("req_id", "state", "result", "sent", "counter")


@query(f"WITH {_DECIDE} SELECT state, result, sent, counter, count(*) AS n FROM d GROUP BY state, result, sent, counter")
def serve_summary(v: Views) -> DataFrame:
    return decided(v).groupBy("state", "result", "sent", "counter").agg(F.count("*").alias("n"))


@query("""
SELECT req_id, CASE WHEN state = 'current' THEN 'served' WHEN state <> 'missing' THEN 'stale' WHEN load_avg > 50 THEN '404' WHEN render_ms <= 3000 THEN 'served' ELSE '404' END AS result,
  CASE WHEN state = 'missing' THEN 'RenderBulk' END AS sent, CASE WHEN state = 'current' THEN 'FRESH' WHEN state = 'missing' AND load_avg <= 50 AND render_ms <= 3000 THEN 'FRESH_RENDER' END AS counter FROM tile_states
""")
def serve_decision_bulk(v: Views) -> DataFrame:
    return decided(v, BULK).select("req_id", "result", "sent", "counter")


@query("SELECT req_id, CASE WHEN req_id % 10 = 0 THEN '404' ELSE 'ok' END AS result, CASE WHEN req_id % 10 > 1 THEN 'Dirty' END AS sent FROM tile_requests")
def dirty_handler(v: Views) -> DataFrame:
    """/dirty under three servers by request: switched off, bulk mode, normal."""
    off, bulk, normal = (W.dirty(CFG.merged(over)) for over in ({"enable_dirty_url": False}, {"enable_bulk_mode": True}, {}))
    which = lambda k: F.when(C("req_id") % 10 == 0, off[k]).when(C("req_id") % 10 == 1, bulk[k]).otherwise(normal[k])
    return v.tile_requests.select("req_id", which("result").alias("result"), which("sent").alias("sent"))


@query("""
WITH b AS (SELECT *, concat('"', md5(concat(style, CAST(size AS VARCHAR))), '"') AS tag FROM tile_states)
SELECT req_id, CASE WHEN size <= 0 THEN 404 WHEN req_id % 6 = 0 THEN 304 ELSE 200 END AS status, CASE WHEN size > 0 THEN tag END AS etag, CASE WHEN size > 0 AND req_id % 6 > 0 THEN size END AS n_bytes FROM b
""")
def serve_body(v: Views) -> DataFrame:
    """Read, tag and answer: 200, 304 where the client's tag is the same, 404 where nothing is stored."""
    tag = W.etag(F.concat(C("style"), C("size").cast("string")))
    asked = F.when(C("req_id") % 6 == 0, tag).otherwise(F.lit('"x"'))
    return states(v).select("req_id", *[c.alias(k) for k, c in W.body(C("size"), tag, asked).items()])


@query("SELECT req_id, req_id % 6 = 0 AS not_modified FROM tile_requests")
def conditional_get(v: Views) -> DataFrame:
    tag = W.etag(C("url"))
    asked = F.when(C("req_id") % 6 == 0, tag).otherwise(W.etag(F.concat(C("url"), F.lit("?"))))
    return v.tile_requests.select("req_id", (asked == tag).alias("not_modified"))


@query("SELECT req_id, concat('\"', md5(url), '\"') AS etag FROM tile_requests")
def etag(v: Views) -> DataFrame:
    return v.tile_requests.select("req_id", W.etag(C("url")).alias("etag"))


@query("""
WITH a AS (SELECT *, CASE WHEN z <= 8 THEN 518400 WHEN z <= 14 THEN 86400 ELSE 10800 END AS low, date_diff('second', mtime, TIMESTAMP '2024-02-01 00:00:00') AS age0,
    CAST(floor(date_diff('microsecond', mtime, TIMESTAMP '2024-02-01 00:00:00') / 1000000) AS BIGINT) AS age FROM tile_states),
m AS (SELECT req_id, CASE WHEN req_id % 17 = 0 THEN 2592000 WHEN state IN ('old', 'veryold') THEN 900 + CAST(floor(450.0 * u) AS BIGINT)
  ELSE least(greatest(CASE WHEN z > 18 THEN 0 ELSE low END, coalesce(CAST(floor(age * 0.1) AS BIGINT), 0)) + CAST(floor(10800 * u) AS BIGINT), 604800) END AS max_age FROM (SELECT *, (req_id % 4) / 4.0 AS u FROM a))
SELECT req_id, CAST(max_age AS BIGINT) AS max_age, TIMESTAMP '2024-02-01 00:00:00' + to_seconds(CAST(max_age AS BIGINT)) AS expires FROM m
""")
def max_age(v: Views) -> DataFrame:
    host = F.when(C("req_id") % 17 == 0, "a.extended.example.org").otherwise("a.example.org")
    age = W.max_age(C("state"), C("z"), F.lit(18), C("mtime"), fr.timestamp(NOW), host, C("req_id") % 4 / 4.0, CFG)
    return states(v).select("req_id", age.alias("max_age")).withColumn("expires", F.expr(f"TIMESTAMP_NTZ '{NOW}' + make_dt_interval(0, 0, 0, max_age)"))


@query("SELECT req_id, CASE WHEN z <= 8 THEN 518400 WHEN z <= 14 THEN 86400 ELSE 10800 END AS seconds FROM tile_requests")
def min_cache_time(v: Views) -> DataFrame:
    return v.tile_requests.select("req_id", W.min_cache_time(C("z"), CFG).alias("seconds"))


@query("SELECT req_id, CASE req_id % 4 WHEN 0 THEN 'Dirty' WHEN 1 THEN 'RenderLow' WHEN 2 THEN 'Render' ELSE 'RenderPrio' END AS cmd, 'RenderBulk' AS bulk_cmd FROM tile_requests")
def priority_map(v: Views) -> DataFrame:
    return v.tile_requests.select("req_id", W.command_for(C("req_id") % 4).alias("cmd"), W.command_for(C("req_id") % 4, bulk=True).alias("bulk_cmd"))


@query("""
WITH u AS (SELECT req_id, url, min(layer_no) AS layer_no FROM url_cases LEFT JOIN layers ON starts_with(url, baseuri) GROUP BY req_id, url)
SELECT req_id, layer_no FROM u
""")
def route_first_match(v: Views) -> DataFrame:
    return fr.first_match(v.url_cases.select("req_id", "url"), v.layers).select("req_id", "layer_no")


_ROUTE = r"""
WITH u AS (SELECT req_id, url, min(layer_no) AS n FROM url_cases LEFT JOIN layers ON starts_with(url, baseuri) GROUP BY req_id, url),
r AS (SELECT req_id, url, l.*, substr(url, length(baseuri) + 1) AS rest FROM u LEFT JOIN layers l ON l.layer_no = u.n),
p AS (SELECT *, regexp_extract(rest, '^\s*([-+]?\d+)/\s*([-+]?\d+)/\s*([-+]?\d+)\.([a-z]{1,255})(?:/(\S{1,10}))?', ['z', 'x', 'y', 'e', 't']) AS m FROM r),
q AS (SELECT *, TRY_CAST(m.z AS BIGINT) AS tz, TRY_CAST(m.x AS BIGINT) AS tx, TRY_CAST(m.y AS BIGINT) AS ty FROM p),
h AS (SELECT *, CASE WHEN starts_with(url, '/server_stats') THEN 'stats' WHEN starts_with(url, '/metrics') THEN 'metrics' WHEN baseuri IS NULL THEN 'declined'
  WHEN starts_with(rest, 'tile-layer.json') THEN 'json' WHEN coalesce(m.e, '') <> ext THEN 'declined'
  WHEN NOT (tz BETWEEN minzoom AND maxzoom AND tx BETWEEN 0 AND CAST(pow(2, tz) AS BIGINT) * aspect_x - 1 AND ty BETWEEN 0 AND CAST(pow(2, tz) AS BIGINT) * aspect_y - 1) THEN 'notfound'
  WHEN m.t = '' THEN 'serve' WHEN m.t = 'status' THEN 'status' WHEN m.t = 'dirty' THEN 'dirty' ELSE 'declined' END AS handler FROM q)"""


@query(_ROUTE + """
SELECT req_id, layer_no, handler, CASE WHEN handler IN ('serve', 'status', 'dirty') THEN CAST(tz AS INT) END AS z, CASE WHEN handler IN ('serve', 'status', 'dirty') THEN tx END AS x,
  CASE WHEN handler IN ('serve', 'status', 'dirty') THEN ty END AS y FROM h
""")
def url_route(v: Views) -> DataFrame:
    r = fr.first_match(v.url_cases.select("req_id", "url"), v.layers)
    out = W.route(C("url"), {k: C(k) for k in v.layers.columns})
    return r.select("req_id", "layer_no", *[out[k].alias(k) for k in ("handler", "z", "x", "y")])


@query("""
SELECT req_id, client_ip AS peer, CASE WHEN req_id % 5 = 0 THEN client_ip ELSE concat('192.168.0.', req_id % 250) END AS first_ip,
  CASE WHEN req_id % 5 = 0 THEN client_ip ELSE concat('172.16.', req_id % 9, '.1') END AS last_ip FROM tile_requests
""")
def client_ip(v: Views) -> DataFrame:
    s = lambda c: c.cast("string")
    forwarded = F.when(C("req_id") % 5 > 0, F.concat(F.lit("192.168.0."), s(C("req_id") % 250), F.lit(", 10.9.8.7 172.16."), s(C("req_id") % 9), F.lit(".1")))
    return v.tile_requests.select("req_id", *[W.client_ip(C("client_ip"), forwarded, m).alias(n) for m, n in enumerate(("peer", "first_ip", "last_ip"))])


@query("""
WITH c AS (SELECT req_id, CASE req_id % 4 WHEN 0 THEN '' WHEN 1 THEN '*' ELSE 'http://a.example.org http://b.example.org' END AS policy,
  CASE req_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'http://b.example.org' ELSE 'http://evil.example.org' END AS origin, CASE WHEN req_id % 5 = 0 THEN 'OPTIONS' ELSE 'GET' END AS method FROM tile_requests),
o AS (SELECT *, CASE WHEN policy = '' OR origin IS NULL THEN 'pass' WHEN policy <> '*' AND NOT contains(policy, origin) THEN 'forbidden' WHEN method = 'OPTIONS' THEN 'preflight' ELSE 'pass' END AS outcome FROM c)
SELECT req_id, outcome, CASE WHEN policy = '' OR origin IS NULL OR outcome = 'forbidden' THEN NULL WHEN policy = '*' THEN '*' ELSE origin END AS allow_origin,
  CASE WHEN policy NOT IN ('', '*') AND origin IS NOT NULL AND outcome <> 'forbidden' THEN 'Origin' END AS vary, CASE WHEN outcome = 'preflight' THEN 604800 END AS max_age FROM o
""")
def cors(v: Views) -> DataFrame:
    policy = F.when(C("req_id") % 4 == 0, "").when(C("req_id") % 4 == 1, "*").otherwise("http://a.example.org http://b.example.org")
    origin = F.when(C("req_id") % 3 == 1, "http://b.example.org").when(C("req_id") % 3 == 2, "http://evil.example.org")
    method = F.when(C("req_id") % 5 == 0, "OPTIONS").otherwise("GET")
    return v.tile_requests.select("req_id", *[c.alias(k) for k, c in W.cors(policy, origin, method, F.lit("GET")).items()])


@query("SELECT req_id, CASE WHEN req_id % 2 = 0 AND req_id % 3 = 0 THEN 'gzip' END AS content_encoding, req_id % 2 = 0 AND req_id % 3 <> 0 AS warned FROM tile_requests")
def content_encoding(v: Views) -> DataFrame:
    """gzip where the tile is stored compressed and the client accepts it; else served as it is, with a warning."""
    accepts = F.when(C("req_id") % 3 == 0, "gzip, deflate").otherwise("identity")
    return v.tile_requests.select("req_id", *[c.alias(k) for k, c in W.content_encoding(C("req_id") % 2 == 0, accepts).items()])


@query("SELECT req_id, round(floor(date_diff('microsecond', mtime, TIMESTAMP '2024-02-01 00:00:00') / 1000000) / 86400.0, 6) AS age_days FROM tile_stats")
def tile_age_days(v: Views) -> DataFrame:
    return stats(v).select("req_id", F.round(W.seconds_between(C("mtime"), fr.timestamp(NOW)) / 86400.0, 6).alias("age_days"))


@query("SELECT req_id, render_ms <= 3000 AS in_time FROM tile_states")
def timeout_outcome(v: Views) -> DataFrame:
    return states(v).select("req_id", W.renders_in_time(C("state"), C("render_ms"), CFG).alias("in_time"))


_PLACE = f"concat('file://', {_PATH})"


@query(f"""
SELECT req_id, CASE WHEN state = 'missing' THEN concat('{W.STATUS_MISSING}', {_PLACE}, chr(10))
  ELSE concat('{W.STATUS_HEAD}', CASE WHEN state IN ('old', 'veryold') THEN 'due to be rendered' ELSE 'clean' END, '. Last rendered at ', strftime(mtime, '%Y-%m-%d %H:%M:%S'), '. Last accessed at ',
    strftime(mtime, '%Y-%m-%d %H:%M:%S'), '. Stored in ', {_PLACE}, chr(10), chr(10), '{W.STATUS_TAIL}', chr(10)) END AS status FROM tile_states
""")
def tile_status(v: Views) -> DataFrame:
    """Text of /status of a file store, which names the place of the tile."""
    placed = FileStore(TILE_DIR).storage_id(states(v))
    return placed.select("req_id", W.status_text(C("state"), C("mtime"), C("mtime"), C("storage_id")).alias("status"))


@query("""
WITH h AS (SELECT layer_no, style, baseuri, minzoom, maxzoom, ext, unnest(['http://a.example.org', 'http://b.example.org']) AS host, unnest([1, 2]) AS n FROM many_layers),
t AS (SELECT layer_no, string_agg(concat(chr(9), chr(9), '"', host, baseuri, '{z}/{x}/{y}.', ext, '"'), concat(',', chr(10)) ORDER BY n) AS tiles FROM h GROUP BY layer_no)
SELECT layer_no, concat('{', chr(10), chr(9), '"tilejson": "2.0.0",', chr(10), chr(9), '"schema": "xyz",', chr(10), chr(9), '"name": "', style, '",', chr(10), chr(9), '"description": "",', chr(10), chr(9),
  '"attribution": "(c)",', chr(10), chr(9), '"minzoom": ', minzoom, ',', chr(10), chr(9), '"maxzoom": ', maxzoom, ',', chr(10), chr(9), '"tiles": [', chr(10), tiles, chr(10), chr(9), ']', chr(10), '}', chr(10)) AS document
FROM many_layers JOIN t USING (layer_no)
""")
def tilejson(v: Views) -> DataFrame:
    """TileJSON 2.0.0 of every layer, laid out exactly as clients get it."""
    hosts = F.array(F.lit("http://a.example.org"), F.lit("http://b.example.org"))
    return v.many_layers.select("layer_no", W.tilejson({c: C(c) for c in v.many_layers.columns}, hosts, F.lit(""), F.lit("(c)")).alias("document"))


@query("SELECT req_id, CASE WHEN req_id % 2 = 0 THEN 'text/javascript' ELSE 'image/png' END AS mime, CASE WHEN req_id % 2 = 0 THEN '*' ELSE '' END AS cors FROM tile_requests")
def legacy_mime(v: Views) -> DataFrame:
    ext = F.when(C("req_id") % 2 == 0, "js").otherwise("png")
    return v.tile_requests.select("req_id", *[c.alias(k) for k, c in W.legacy_type(ext).items()])


@query("SELECT doc_id, coalesce(CASE WHEN lang = 'de' THEN text END, CASE WHEN lang = 'en' THEN text END, source) AS name FROM documents")
def localized_name(v: Views) -> DataFrame:
    tags = F.create_map(F.concat(F.lit("name:"), C("lang")), C("text"))
    return v.documents.select("doc_id", W.localized_name(tags, C("source"), "de,en,_").alias("name"))


@query("SELECT req_id, client_ip NOT IN ('10.0.7.1', '10.0.13.1') AS counted FROM tile_requests")
def whitelist(v: Views) -> DataFrame:
    """Clients on the white list are never counted against a bucket."""
    return v.tile_requests.select("req_id", (~C("client_ip").isin("10.0.7.1", "10.0.13.1")).alias("counted"))


@query("""
SELECT req_id, x = rx AND y = ry AND z = rz AND style = rs AS matched FROM (SELECT *, CASE WHEN req_id % 9 = 0 THEN x + 1 ELSE x END AS rx, y AS ry, z AS rz, CASE WHEN req_id % 8 = 0 THEN 'default' ELSE style END AS rs FROM tile_requests)
""")
def response_match(v: Views) -> DataFrame:
    """Answers of the renderer that name the tile asked for."""
    got = {"x": F.when(C("req_id") % 9 == 0, C("x") + 1).otherwise(C("x")), "y": C("y"), "z": C("z"), "style": F.when(C("req_id") % 8 == 0, "default").otherwise(C("style"))}
    return v.tile_requests.select("req_id", W.answers({k: C(k) for k in got}, got).alias("matched"))


_OFF = CFG.merged({"enable_status_url": False, "enable_dirty_url": False, "enable_global_stats": False})


@query(_ROUTE + " SELECT req_id, CASE WHEN handler IN ('stats', 'metrics') THEN 'error' WHEN handler IN ('status', 'dirty') THEN 'notfound' ELSE handler END AS handler FROM h")
def switched_off(v: Views) -> DataFrame:
    """Handlers of a server that has its statistics, /status and /dirty switched off."""
    r = fr.first_match(v.url_cases.select("req_id", "url"), v.layers)
    return r.select("req_id", W.route(C("url"), {k: C(k) for k in v.layers.columns}, cfg=_OFF)["handler"].alias("handler"))
