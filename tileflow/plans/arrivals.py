"""Queries on what arrives over time: bytes of connections, answers, imports; and on routing to very many layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.functions import web as W
from tileflow.operators import connections
from tileflow.operators import freshness as fr
from tileflow.operators.freshness import KEY
from tileflow.plans.registry import query
from tileflow.sources import wire
from tileflow.sources.views import Views

C = F.col


def chunks(v: Views) -> DataFrame:
    """(conn, seq, chunk): the requests of each client as frames of versions 1 to 3, cut anywhere; the third frame of each seventh client
    is of no known version. A chunk is the end of a frame and the beginning of the next, cut once more."""
    r = fr.numbered(v.tile_requests, "client_id", "req_id")
    of = lambda ver: wire.encode(C("cmd"), C("x"), C("y"), C("z"), C("style"), F.lit("image/png"), F.lit(""), ver)
    ver = C("req_id") % 3 + 1
    frame = F.when(ver == 1, of(1)).when(ver == 2, of(2)).otherwise(of(3))
    bad = (C("client_id") % 7 == 3) & (C("arrival") == 3)
    frame = F.when(bad, F.concat(wire.int32(F.lit(9)), F.substring(frame, F.lit(5), F.length(frame)))).otherwise(frame)
    f = r.select(C("client_id").alias("conn"), C("arrival").alias("n"), C("req_id"), frame.alias("frame"))
    at = (C("req_id") * 31 % (F.length("frame") + 1)).cast("int")
    ends = F.array(F.struct((C("n") - 1).alias("seq"), F.lit(True).alias("head"), F.substring(C("frame"), F.lit(1), at).alias("part")), F.struct(C("n").alias("seq"), F.lit(False).alias("head"), F.substring(C("frame"), at + 1, F.length("frame")).alias("part")))
    f = f.select("conn", F.explode(ends).alias("e")).select("conn", "e.*")
    part = lambda head: F.coalesce(F.max(F.when(C("head") == head, C("part"))), F.lit(b""))
    f = f.groupBy("conn", "seq").agg(F.concat(part(False), part(True)).alias("chunk"))
    at = ((C("conn") + C("seq") * 7) % (F.length("chunk") + 1)).cast("int")
    twice = F.array(F.struct((C("seq") * 2).alias("seq"), F.substring(C("chunk"), F.lit(1), at).alias("chunk")), F.struct((C("seq") * 2 + 1).alias("seq"), F.substring(C("chunk"), at + 1, F.length("chunk")).alias("chunk")))
    return f.select("conn", F.explode(twice).alias("e")).select("conn", "e.*")


@query("""
SELECT client_id AS conn, n, ver, cmd, x, y, z, CASE WHEN ver = 1 THEN 'default' ELSE style END AS style
FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY req_id) - 1 AS n, CAST(req_id % 3 + 1 AS INT) AS ver FROM tile_requests) WHERE NOT (client_id % 7 = 3 AND n >= 2)
""")
def wire_reassemble(v: Views) -> DataFrame:
    """Chunks of connections as the requests they carry; a frame of unknown version ends its connection."""
    r = wire.upgraded(wire.decode(connections.reassembled(chunks(v))))
    return r.select("conn", "n", C("ver").cast("int").alias("ver"), "cmd", "x", "y", "z", "style")


def _micros(c: str):
    return F.unix_micros(C(c).cast("timestamp"))


def answers(v: Views) -> DataFrame:
    """Answers of the renderer: four fifths of the requests get one after their render time, a seventh of these to the wrong metatile."""
    a = v.tile_requests.where("req_id % 5 <> 0")
    return a.select("style", "z", F.when(C("req_id") % 7 == 0, C("mx") + 8).otherwise(C("mx")).alias("mx"), "my", (_micros("ts") + C("render_ms") * 1000).alias("us"))


@query("""
WITH a AS (SELECT style, z, CASE WHEN req_id % 7 = 0 THEN mx + 8 ELSE mx END AS mx, my, epoch_us(ts) + render_ms * 1000 AS us FROM tile_requests WHERE req_id % 5 <> 0),
r AS (SELECT *, epoch_us(ts) AS us FROM tile_requests)
SELECT r.req_id, CASE WHEN min(a.us) IS NULL THEN 'timeout' ELSE 'answered' END AS outcome, min(a.us) - any_value(r.us) AS waited_us
FROM r LEFT JOIN a ON a.style = r.style AND a.z = r.z AND a.mx = r.mx AND a.my = r.my AND a.us BETWEEN r.us AND r.us + 3000000 GROUP BY r.req_id
""")
def answer_in_time(v: Views) -> DataFrame:
    """Requests that wait for the renderer, and the first answer to their metatile within three seconds."""
    r = connections.answered(v.tile_requests.select("req_id", *KEY, _micros("ts").alias("us")), answers(v), KEY)
    return r.select("req_id", F.when(C("answered_us").isNull(), "timeout").otherwise("answered").alias("outcome"), (C("answered_us") - C("us")).alias("waited_us"))


def imports(v: Views) -> DataFrame:
    """Imports of single styles and of all, as some events say."""
    e = v.events
    own = e.where("event_id % 500 = 0").select(C("event_type").alias("style"), C("ts").alias("at"), (C("ts") - F.expr("INTERVAL 1 HOUR")).alias("planet_ts"))
    return own.unionByName(e.where("event_id % 700 = 0").select(F.lit("*").alias("style"), C("ts").alias("at"), C("ts").alias("planet_ts")))


@query("""
WITH i AS (SELECT event_type AS style, ts AS came, ts - INTERVAL 1 HOUR AS planet_ts FROM events WHERE event_id % 500 = 0 UNION ALL SELECT '*', ts, ts FROM events WHERE event_id % 700 = 0),
k AS (SELECT style, (epoch_us(came) + 299999999) // 300000000 AS look, arg_max(planet_ts, came) AS planet_ts FROM i GROUP BY ALL),
r AS (SELECT q.req_id, q.style, c.mtime, epoch_us(q.ts) // 300000000 AS look FROM tile_requests q LEFT JOIN tile_cache c ON c.style = q.style AND c.z = q.z AND c.mx = q.mx AND c.my = q.my),
o AS (SELECT r.*, k.planet_ts AS own FROM r ASOF LEFT JOIN k ON k.style = r.style AND r.look >= k.look),
a AS (SELECT o.*, e.planet_ts AS every FROM o ASOF LEFT JOIN (SELECT * FROM k WHERE style = '*') e ON o.look >= e.look),
p AS (SELECT *, coalesce(own, every, make_timestamp((look * 300 - 259200) * 1000000)) AS planet_ts FROM a)
SELECT req_id, planet_ts, coalesce(mtime < planet_ts, true) AS expired FROM p
""")
def import_asof(v: Views) -> DataFrame:
    """Each request judged by the import its server knew of then: it looks for a new one every five minutes."""
    r = v.tile_requests.select("req_id", "ts", *KEY).join(v.tile_cache.select(*KEY, "mtime"), KEY, "left")
    out = fr.with_import_then(r, imports(v))
    return out.select("req_id", "planet_ts", F.coalesce(C("mtime") < C("planet_ts"), F.lit(True)).alias("expired"))


_MANY = """
l AS (SELECT c_custkey AS layer_no, concat('/c', c_custkey % 300, '/', CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat(c_nationkey, '/') ELSE 't' END) AS baseuri FROM customer),
u AS (SELECT req_id, CASE WHEN req_id % 19 = 0 THEN 'c' WHEN req_id % 23 = 0 THEN '/' ELSE concat('/c', client_id % 400, '/', CASE WHEN req_id % 2 = 0 THEN concat(z, '/') ELSE '' END, 'tiles', url) END AS url FROM tile_requests)"""


@query(f"WITH {_MANY} SELECT u.req_id, min(l.layer_no) AS layer_no FROM u LEFT JOIN l ON starts_with(u.url, l.baseuri) GROUP BY u.req_id")
def route_many(v: Views) -> DataFrame:
    """First match among as many layers as there are customers."""
    s = lambda c: C(c).cast("string")
    k = C("c_custkey")
    base = F.concat(F.lit("/c"), (k % 300).cast("string"), F.lit("/"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(s("c_nationkey"), F.lit("/"))).otherwise("t"))
    url = F.concat(F.lit("/c"), (C("client_id") % 400).cast("string"), F.lit("/"), F.when(C("req_id") % 2 == 0, F.concat(s("z"), F.lit("/"))).otherwise(""), F.lit("tiles"), C("url"))
    u = v.tile_requests.select("req_id", F.when(C("req_id") % 19 == 0, "c").when(C("req_id") % 23 == 0, "/").otherwise(url).alias("url"))
    return fr.first_match(u, v.customer.select(k.alias("layer_no"), base.alias("baseuri"))).select("req_id", "layer_no")


_FOUND = "handler IN ('serve', 'status', 'dirty')"


@query(rf"""
WITH u AS (SELECT req_id, style, concat('/tiles/', style, '/', CASE req_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en,_' WHEN 2 THEN '' ELSE 'fr' END, '/', z, '/', x, '/', y, '.png', CASE WHEN req_id % 11 = 0 THEN '/dirty' ELSE '' END) AS url FROM tile_requests),
n AS (SELECT req_id, url, min(layer_no) AS n FROM u JOIN layers ON starts_with(url, baseuri) GROUP BY req_id, url),
p AS (SELECT req_id, l.*, regexp_extract(substr(url, length(baseuri) + 1), '^([^/]{{1,40}})/\s*([-+]?\d+)/\s*([-+]?\d+)/\s*([-+]?\d+)\.([a-z]{{1,255}})(?:/(\S{{1,10}}))?', ['o', 'z', 'x', 'y', 'e', 't']) AS m FROM n JOIN layers l ON l.layer_no = n.n),
q AS (SELECT *, TRY_CAST(m.z AS BIGINT) AS tz, TRY_CAST(m.x AS BIGINT) AS tx, TRY_CAST(m.y AS BIGINT) AS ty FROM p),
h AS (SELECT *, CASE WHEN coalesce(m.e, '') <> ext THEN 'declined'
  WHEN NOT (tz BETWEEN minzoom AND maxzoom AND tx BETWEEN 0 AND CAST(pow(2, tz) AS BIGINT) * aspect_x - 1 AND ty BETWEEN 0 AND CAST(pow(2, tz) AS BIGINT) * aspect_y - 1) THEN 'notfound'
  WHEN m.t = '' THEN 'serve' WHEN m.t = 'dirty' THEN 'dirty' ELSE 'declined' END AS handler FROM q)
SELECT req_id, handler, CASE WHEN {_FOUND} THEN m.o END AS options, CASE WHEN {_FOUND} THEN CAST(tz AS INT) END AS z, CASE WHEN {_FOUND} THEN tx END AS x, CASE WHEN {_FOUND} THEN ty END AS y FROM h
""")
def url_route_options(v: Views) -> DataFrame:
    """Urls with options before the address, as servers with parameterised layers take them."""
    words = reduce(lambda x, p: x.when(C("req_id") % 4 == p[0], p[1]), ((1, "en,_"), (2, ""), (3, "fr")), F.when(C("req_id") % 4 == 0, "de"))
    s = lambda c: C(c).cast("string")
    url = F.concat(F.concat_ws("/", F.lit("/tiles"), "style", words, s("z"), s("x"), s("y")), F.lit(".png"), F.when(C("req_id") % 11 == 0, "/dirty").otherwise(""))
    r = fr.first_match(v.tile_requests.select("req_id", url.alias("url")), v.layers)
    out = W.route(C("url"), {k: C(k) for k in v.layers.columns}, with_options=True)
    return r.select("req_id", *[out[k].alias(k) for k in ("handler", "options", "z", "x", "y")])
