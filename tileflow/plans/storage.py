"""Queries on tile stores, containers and configuration."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.functions import address as A
from tileflow.operators import freshness as fr
from tileflow.operators.freshness import KEY
from tileflow.plans.registry import query
from tileflow.plans.serving import stats
from tileflow.sources import config, files, htcp, metatile, shared, stores
from tileflow.sources.views import NOW, Views

C = F.col


def tiles(v: Views) -> DataFrame:
    """Tiles to store: every requested tile once, with its address as content; a quarter of them empty."""
    data = F.when(C("x") % 4 == 3, "").otherwise(F.concat(F.lit("tile "), F.concat_ws("/", C("style"), C("z").cast("string"), C("x").cast("string"), C("y").cast("string"))))
    return v.tile_requests.select("style", "z", "mx", "my", "x", "y").distinct().withColumn("data", data.cast("binary"))


def containers(v: Views) -> DataFrame:
    return metatile.encoded(tiles(v), KEY)


_DATA = "CASE WHEN x % 4 = 3 THEN '' ELSE concat('tile ', style, '/', z, '/', x, '/', y) END"
_BLOB_SIZE = f"WITH t AS (SELECT DISTINCT style, z, mx, my, x, y, {_DATA} AS data FROM tile_requests)"


def _le(n: str) -> str:
    """Hexadecimal text of a 32-bit number, least byte first, in the oracle's SQL."""
    h = f"printf('%08X', CAST({n} AS BIGINT))"
    return f"concat({', '.join(f'substr({h}, {i}, 2)' for i in (7, 5, 3, 1))})"


@query(f"""
{_BLOB_SIZE}, slots AS (SELECT k.*, s.slot, coalesce(t.data, '') AS data FROM (SELECT DISTINCT style, z, mx, my FROM t) k CROSS JOIN (SELECT unnest(range(64)) AS slot) s
  LEFT JOIN t ON t.style = k.style AND t.z = k.z AND t.mx = k.mx AND t.my = k.my AND (t.x % 8) * 8 + t.y % 8 = s.slot),
e AS (SELECT *, length(data) AS n, 532 + coalesce(sum(length(data)) OVER (PARTITION BY style, z, mx, my ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM slots)
SELECT style, z, mx, my, CAST(532 + sum(n) AS BIGINT) AS size, concat(hex(encode('META')), {_le("64")}, {_le("mx")}, {_le("my")}, {_le("z")}, string_agg(concat({_le("pos")}, {_le("n")}), '' ORDER BY slot), string_agg(hex(encode(data)), '' ORDER BY slot)) AS blob
FROM e GROUP BY style, z, mx, my
""")
def metatile_encode(v: Views) -> DataFrame:
    """Containers, byte by byte."""
    return containers(v).select(*KEY, F.length("blob").cast("long").alias("size"), F.hex("blob").alias("blob"))


@query(f"{_BLOB_SIZE} SELECT style, z, x, y, data FROM t WHERE data <> ''")
def metatile_decode(v: Views) -> DataFrame:
    """Containers taken apart again: the tiles as they were, unset slots left out."""
    d = metatile.decoded(containers(v)).where("size > 0")
    return d.select("style", "z", (C("mx") + F.floor(C("slot") / 8)).alias("x"), (C("my") + C("slot") % 8).alias("y"), C("data").cast("string").alias("data"))


@query(f"SELECT req_id, CAST(length({_DATA}) AS INT) AS status, {_DATA} AS data FROM tile_requests")
def metatile_read(v: Views) -> DataFrame:
    """Every request read from the container of its metatile."""
    key = A.store_keys(C("style"), C("z"), C("mx"), C("my"), F.lit(""))["rados_key"]
    r = stores.tiles_of(v.tile_requests, containers(v).select(key.alias("stored_key"), "blob"), key)
    return r.select("req_id", "status", C("data").cast("string").alias("data"))


@query("SELECT req_id, CASE req_id % 7 WHEN 0 THEN -1 WHEN 1 THEN -2 WHEN 2 THEN -3 WHEN 3 THEN -4 WHEN 4 THEN -5 WHEN 5 THEN -8 ELSE 0 END AS code FROM tile_requests")
def metatile_validate(v: Views) -> DataFrame:
    """Containers spoiled in different ways, and the code each gives. Each kind of spoiling of a tile is checked once."""
    asked = v.tile_requests.select("req_id", *KEY, "x", "y", (C("req_id") % 7).alias("kind"))
    one = [*KEY, "x", "y", "kind"]
    r = asked.groupBy(*one).agg(F.min("req_id").alias("req_id")).join(containers(v), KEY)
    i, b = C("req_id") % 7, C("blob")
    bad = (
        F.when(i == 0, None).when(i == 1, F.lit(b"")).when(i == 2, F.substring(b, 1, 12)).when(i == 3, F.concat(F.lit(b"MOTE"), F.substring(b, F.lit(5), F.length(b))))
        .when(i == 4, F.concat(F.substring(b, 1, 4), F.lit(b"\x3f\x00\x00\x00"), F.substring(b, F.lit(9), F.length(b))))
        .when(i == 5, F.concat(F.substring(b, 1, 20), F.lit(b"\x00\x00\x00\x00\x00\x00\x0f\x00" * 64), F.lit(b"x"))).otherwise(b)
    )
    status = metatile.read_status(bad, A.metatile_slot(C("x"), C("y")))
    codes = shared.staged(r.select(*one, F.least(status, F.lit(0)).cast("int").alias("code")), "codes")
    return asked.join(codes, one).select("req_id", "code")


def _written(v: Views) -> stores.FileStore:
    """A new file store that holds all containers, packed: as single files 36 million requests take 34 million inodes."""
    store = stores.FileStore(f"{shared.own_folder(v.spark)}/store-{uuid.uuid4().hex}", now=NOW, packed=True)
    store.write(containers(v))
    return store


def _table(v: Views, layout: str, metatiles: DataFrame) -> stores.TableStore:
    """A new key-value store that holds these metatiles."""
    store = stores.open_store(f"{layout}://tiles-{uuid.uuid4().hex}", tables=shared.own_folder(v.spark))
    store.write(metatiles)
    return store


@query("SELECT DISTINCT style, z, mx, my FROM tile_requests")
def metatile_write(v: Views) -> DataFrame:
    """All containers written as .meta files in archives, and read back through the data source."""
    root = _written(v).root
    back = v.spark.read.format("metatiles").option("root", root).option("packed", True).option("contents", "false").load()
    return stores.parsed(back.select("path"), root).select("style", "z", C("x").alias("mx"), C("y").alias("my"))


@query("SELECT DISTINCT style, z, mx, my FROM tile_requests WHERE z BETWEEN 4 AND 12 AND style IN ('click', 'error')")
def scan_meta(v: Views) -> DataFrame:
    """The .meta files of two styles and nine zooms: other folders' archives are not opened."""
    root = _written(v).root
    found = stores.scan(v.spark, root, ["click", "error"], 4, 12, packed=True)
    return stores.parsed(found.select("path"), root).select("style", "z", C("x").alias("mx"), C("y").alias("my"))


@query(f"SELECT req_id, CAST(length({_DATA}) AS INT) AS status, {_DATA} AS data FROM tile_requests")
def file_tile_read(v: Views) -> DataFrame:
    """Every request read from the .meta files, which lie in archives."""
    out = _written(v).read(v.tile_requests.select("req_id", *KEY, "x", "y"))
    return out.select("req_id", "status", C("data").cast("string").alias("data"))


_KEPT_BLOBS = f"""k AS (SELECT style, z, mx, my, CAST(532 + sum(length(data)) AS BIGINT) AS n FROM (SELECT DISTINCT style, z, mx, my, x, y, {_DATA} AS data FROM tile_requests WHERE req_id % 4 <> 0) GROUP BY style, z, mx, my)"""


def _cached_blobs(v: Views) -> DataFrame:
    """Containers of the tiles of the cache, with its times."""
    kept = v.tile_requests.where("req_id % 4 <> 0").select("style", "z", "x", "y").distinct()
    blobs = metatile.encoded(tiles(v).join(kept, ["style", "z", "x", "y"], "left_semi"), KEY)
    return blobs.join(v.tile_cache.select(*KEY, "mtime"), KEY)


@query(f"""
WITH {_KEPT_BLOBS} SELECT req_id, CASE WHEN size < 0 THEN -1 ELSE n END AS size, date_trunc('second', mtime) AS mtime, size < 0 OR date_trunc('second', mtime) < planet_ts AS expired
FROM tile_stats LEFT JOIN k USING (style, z, mx, my)
""")
def file_tile_stat(v: Views) -> DataFrame:
    """File store: the size is the file's; what is older than its style's import, or missing, is expired."""
    store = stores.FileStore(f"{shared.own_folder(v.spark)}/store-{uuid.uuid4().hex}", now=NOW, packed=True)
    store.write(_cached_blobs(v))
    for style, at in v.planet_times.select("style", F.unix_seconds(C("planet_ts").cast("timestamp")).alias("at")).collect():  # a row a style
        files.mark_import(store.root, None if style == "*" else style, at)
    return store.stat(v.tile_requests.select("req_id", "style", "z", "x", "y")).select("req_id", "size", "mtime", "expired")


@query(f"SELECT req_id, CAST(length({_DATA}) AS INT) AS memcached_status, CAST(length({_DATA}) AS INT) AS rados_status FROM tile_requests")
def kv_tile_read(v: Views) -> DataFrame:
    """The same tiles from the two key layouts."""
    blobs, requests = shared.staged(containers(v), "containers"), v.tile_requests.select("req_id", "style", "z", "x", "y")
    m, d = (_table(v, layout, blobs).read(requests).select("req_id", C("status").alias(f"{layout}_status")) for layout in ("memcached", "rados"))
    return m.join(d, "req_id")


_CACHED = f"WITH t AS (SELECT DISTINCT style, z, x, y, CAST(length({_DATA}) AS BIGINT) AS n FROM tile_requests WHERE req_id % 4 <> 0)"


@query(f"{_CACHED} SELECT req_id, CASE WHEN size < 0 THEN -1 ELSE coalesce(n, 0) END AS size, mtime, coalesce(mtime < planet_ts, false) AS expired FROM tile_stats LEFT JOIN t USING (style, z, x, y)")
def kv_tile_stat(v: Views) -> DataFrame:
    """Key-value store: the size is the tile's own entry, a missing tile is not expired."""
    store = _table(v, "memcached", _cached_blobs(v))
    found = store.stat(v.tile_requests.select("req_id", "style", "z", "x", "y"))
    found = fr.with_planet_time(found, v.planet_times, NOW)
    return found.select("req_id", "size", "mtime", (C("expired") | F.coalesce(C("mtime") < C("planet_ts"), F.lit(False))).alias("expired"))


@query("SELECT concat(style, '/', mx, '/', my, '/', z, '.meta') AS key, min(ts) AS mtime, false AS expired FROM tile_requests GROUP BY style, mx, my, z")
def kv_write(v: Views) -> DataFrame:
    """Metatiles written to a key-value store twice, the later time last: one row counts for each key."""
    rows = v.tile_requests.groupBy(*KEY).agg(F.min("ts").alias("mtime"))
    store = _table(v, "memcached", rows.withColumn("mtime", C("mtime") - F.expr("INTERVAL 1 DAY")))
    store.write(rows)
    return store.latest(v.spark, "mtime", "expired")


_MISSING = "size < 0"


@query(f"SELECT req_id, CASE WHEN {_MISSING} THEN -1 ELSE CAST(length({_DATA}) AS BIGINT) END AS size, CASE WHEN size >= 0 THEN mtime END AS last_modified, false AS expired FROM tile_stats")
def proxy_stat(v: Views) -> DataFrame:
    """A read-only proxy answers 200 with Last-Modified and the tile, or 404: size -1; nothing it serves is expired."""
    known = stats(v).select("style", "z", "x", "y", "size", "mtime").distinct().join(tiles(v).select("style", "z", "x", "y", "data"), ["style", "z", "x", "y"])
    path = F.concat_ws("/", F.lit(""), C("style"), A.store_keys(C("style"), C("z"), C("x"), C("y"), F.lit(""))["proxy_path"])
    responses = known.select(path.alias("path"), F.when(C("size") < 0, 404).otherwise(200).alias("http"), C("mtime").alias("last_modified"), C("data").alias("body"))
    store = stores.open_store("ro_http_proxy://tiles.example.org", responses=responses)
    return store.stat(v.tile_requests.select("req_id", "style", "z", "x", "y")).select("req_id", "size", C("mtime").alias("last_modified"), "expired")


_TWO = "FROM (SELECT * FROM tile_cache WHERE style = 'view') p {0} JOIN (SELECT * FROM tile_cache WHERE style = 'click') s ON p.z = s.z AND p.mx = s.mx AND p.my = s.my"


@query(f"SELECT p.z, p.mx, p.my, p.size AS stat_size, s.size IS NOT NULL AS readable {_TWO.format('LEFT')}")
def composite_join(v: Views) -> DataFrame:
    """Reading an overlay needs both tiles; its state is the lower one's alone."""
    key = ["z", "mx", "my"]
    p = v.tile_cache.where("style = 'view'").select(*key, C("size").alias("stat_size"))
    s = v.tile_cache.where("style = 'click'").select(*key, F.lit(True).alias("over"))
    return p.join(s, key, "left").select(*key, "stat_size", F.coalesce("over", F.lit(False)).alias("readable"))


@query(f"""
{_BLOB_SIZE} SELECT u.z, u.x, u.y, CASE WHEN m.z IS NULL THEN -1 ELSE CAST(length(u.data) AS INT) END AS status, u.data, CASE WHEN m.z IS NOT NULL THEN coalesce(o.data, '') END AS over
FROM (SELECT * FROM t WHERE style = 'view') u LEFT JOIN (SELECT DISTINCT z, mx, my FROM t WHERE style = 'click') m ON m.z = u.z AND m.mx = u.mx AND m.my = u.my
LEFT JOIN t o ON o.style = 'click' AND o.z = u.z AND o.x = u.x AND o.y = u.y
""")
def composite_read(v: Views) -> DataFrame:
    """Tiles of one style with those of another over them, from a composite of two key-value stores."""
    name = uuid.uuid4().hex
    store = stores.open_store(f"composite:{{view,memcached://a-{name}}}{{click,rados://b-{name}}}", tables=shared.own_folder(v.spark))
    blobs = containers(v)
    store.lower.write(blobs.where("style = 'view'"))
    store.upper.write(blobs.where("style = 'click'"))
    out = store.read(tiles(v).where("style = 'view'").select("style", "z", "x", "y"))
    return out.select("z", "x", "y", "status", C("data").cast("string").alias("data"), C("over").cast("string").alias("over"))


@query("SELECT req_id, CAST(-1 AS BIGINT) AS size, true AS expired, -1 AS read, 0 AS written FROM tile_requests")
def null_store(v: Views) -> DataFrame:
    """Nothing is found in a null store, and whatever is written to it succeeds."""
    store = stores.open_store("null://")
    store.write(v.tile_requests.select(*KEY))
    out = store.read(store.stat(v.tile_requests.select("req_id", "style", "z", "x", "y")))
    return out.select("req_id", "size", "expired", C("status").alias("read"), F.lit(0).alias("written"))


_URIS = ["/var/tiles", "rados://pool/etc/ceph.conf", "memcached://", "memcached://host:11211", "ro_http_proxy://tiles.example.org", "composite:{a,/srv/a}{b,null://}", "null://", "ftp://x", ""]
_URI = "CASE req_id % 9 " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(_URIS)) + " END"


def _uris(v: Views) -> DataFrame:
    return v.tile_requests.select("req_id", F.element_at(F.array(*map(F.lit, _URIS)), (C("req_id") % 9 + 1).cast("int")).alias("uri"))


@query("SELECT req_id, CASE req_id % 9 WHEN 0 THEN 'file' WHEN 1 THEN 'rados' WHEN 2 THEN 'memcached' WHEN 3 THEN 'memcached' WHEN 4 THEN 'proxy' WHEN 5 THEN 'composite' WHEN 6 THEN 'null' END AS kind FROM tile_requests")
def store_route(v: Views) -> DataFrame:
    return _uris(v).select("req_id", stores.backend(C("uri")).alias("kind"))


@query("""
SELECT req_id, CASE WHEN req_id % 9 = 1 THEN 'pool' END AS pool, CASE WHEN req_id % 9 = 1 THEN '/etc/ceph.conf' END AS conf, CASE req_id % 9 WHEN 2 THEN '--server=localhost' WHEN 3 THEN '--server=host:11211' END AS server,
  CASE WHEN req_id % 9 = 5 THEN 'a' END AS style_1, CASE WHEN req_id % 9 = 5 THEN '/srv/a' END AS uri_1, CASE WHEN req_id % 9 = 5 THEN 'b' END AS style_2, CASE WHEN req_id % 9 = 5 THEN 'null://' END AS uri_2 FROM tile_requests
""")
def store_uri_parse(v: Views) -> DataFrame:
    return _uris(v).select("req_id", *[c.alias(k) for k, c in stores.parse_uri(C("uri")).items()])


@query("SELECT style, z, mx, my FROM tile_cache c WHERE NOT EXISTS (SELECT 1 FROM tile_requests r WHERE r.req_id % 10 = 0 AND r.style = c.style AND r.z = c.z AND r.mx = c.mx AND r.my = c.my)")
def store_delete(v: Views) -> DataFrame:
    store = _table(v, "rados", v.tile_cache.select(*KEY, "mtime"))
    store.delete(v.tile_requests.where("req_id % 10 = 0"))
    store.runs.compact(v.spark)
    return store.latest(v.spark, *KEY).select(*KEY)


@query("SELECT style, z, mx, my, CASE WHEN z % 2 = 0 THEN m ELSE m - INTERVAL 20 YEARS END AS mtime, true AS kv_expired FROM (SELECT *, CASE WHEN z % 2 = 0 THEN mtime - INTERVAL 19 YEARS ELSE mtime END AS m FROM tile_cache)")
def store_expire(v: Views) -> DataFrame:
    """Expired files go back by 20 years unless they are from 2005 or before; a key-value store sets its flag."""
    m = F.when(C("z") % 2 == 0, C("mtime") - F.expr("INTERVAL 19 YEARS")).otherwise(C("mtime"))
    store = _table(v, "memcached", v.tile_cache.select(*KEY, m.alias("mtime")))
    store.expire(v.tile_cache.select(*KEY))
    rows = store.latest(v.spark, *KEY, "mtime", "expired")
    return rows.select(*KEY, stores.expired_time(C("mtime")).alias("mtime"), C("expired").alias("kv_expired"))


@query("""
WITH u AS (SELECT req_id, concat('http://cache.example.org', url) AS url FROM tile_requests)
SELECT req_id, url, octet_length(encode(url)) + 34 AS n_bytes,
  concat(lpad(hex(octet_length(encode(url)) + 34), 4, '0'), '0000', lpad(hex(octet_length(encode(url)) + 30), 4, '0'), '0400000000FF00000004', hex(encode('HEAD')), lpad(hex(octet_length(encode(url))), 4, '0'), hex(encode(url)), '0008', hex(encode('HTTP/1.1')), '0000') AS packet FROM u
""")
def htcp_packets(v: Views) -> DataFrame:
    """Purge datagrams, in hexadecimal; nothing is sent."""
    u = F.concat(F.lit("http://cache.example.org"), C("url"))
    r = v.tile_requests.select("req_id", u.alias("url"))
    return r.select("req_id", "url", (F.octet_length("url") + 34).cast("long").alias("n_bytes"), F.hex(htcp.purge(C("url"))).alias("packet"))


_TYPES = ["png image/png png256", "jpg image/jpeg", "webp   image/webp  webp ", "png", "a b c d"]


@query("""
SELECT req_id, req_id % 5 < 3 AS ok, CASE req_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'webp' END AS ext, CASE req_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/webp' END AS mime,
  CASE req_id % 5 WHEN 0 THEN 'png256' WHEN 1 THEN 'png256' WHEN 2 THEN 'webp' END AS output_format FROM tile_requests
""")
def type_triplet(v: Views) -> DataFrame:
    t = F.element_at(F.array(*map(F.lit, _TYPES)), (C("req_id") % 5 + 1).cast("int"))
    return v.tile_requests.select("req_id", *[c.alias(k) for k, c in config.type_columns(t).items()])


@query("""
SELECT req_id, TRY_CAST(CASE WHEN req_id % 10 = 3 THEN 'abc' ELSE CAST(req_id % 40 - 5 AS VARCHAR) END AS INT) AS value, coalesce(TRY_CAST(CASE WHEN req_id % 10 = 3 THEN 'abc' ELSE CAST(req_id % 40 - 5 AS VARCHAR) END AS INT) BETWEEN 0 AND 20, false) AS ok FROM tile_requests
""")
def opt_validate(v: Views) -> DataFrame:
    text = F.when(C("req_id") % 10 == 3, "abc").otherwise((C("req_id") % 40 - 5).cast("string"))
    value, ok = config.number(text, "int", 0, 20)
    return v.tile_requests.select("req_id", value.alias("value"), ok.alias("ok"))


@query("SELECT req_id, style AS layer, CAST(z AS VARCHAR) AS maxzoom FROM tile_requests")
def kv_options(v: Views) -> DataFrame:
    """Directive arguments of the form key=value."""
    text = F.concat(F.lit("layer="), C("style"), F.lit(" maxzoom="), C("z").cast("string"))
    return v.tile_requests.select("req_id", *[config.option(text, name).alias(name) for name in ("layer", "maxzoom")])


@query("SELECT s_suppkey AS server, CAST(s_suppkey % 5 + 1 + 4 AS BIGINT) AS slave_threads FROM supplier")
def slave_threads(v: Views) -> DataFrame:
    """Threads of all daemons but the active one, in each server's configuration; four where none are given."""
    return config.daemons(v.config_texts).where("daemon <> 0").groupBy("server").agg(F.sum("num_threads").alias("slave_threads"))


@query("""
SELECT s_suppkey AS server, 0 AS layer_no, concat('s', s_suppkey) AS style, concat('/tiles/s', s_suppkey, '/') AS baseuri, 0 AS minzoom, CAST(10 + s_suppkey % 11 AS INT) AS maxzoom, 1 AS aspect_x, CAST(1 AS DOUBLE) AS scale, 'png' AS ext, 'image/png' AS mime, 'png256' AS output_format, false AS enable_options FROM supplier
UNION ALL SELECT s_suppkey, 1, 'labels', '/labels/', CAST(s_suppkey % 5 AS INT), 20, 2, 2.0, 'jpg', 'image/jpeg', 'png256', true FROM supplier WHERE s_suppkey % 3 = 0
""")
def layer_config(v: Views) -> DataFrame:
    """The map sections of each server's configuration, with defaults and a closed URI."""
    return config.parsed(v.config_texts).select("server", "layer_no", "style", "baseuri", "minzoom", "maxzoom", "aspect_x", "scale", "ext", "mime", "output_format", "enable_options")
