"""Queries on counters, monitoring and their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tileflow.constants import MAX_ZOOM
from tileflow.functions import web as W
from tileflow.operators import counters as K
from tileflow.plans.registry import query
from tileflow.plans.serving import decided
from tileflow.sources.views import Views

C = F.col
LAYERS = [(0, "/tiles/click/"), (1, "/tiles/error/"), (2, "/tiles/view/"), (3, "/tiles/signup/"), (4, "/tiles/")]


def outcomes(v: Views) -> DataFrame:
    d = decided(v).join(v.layers.select("style", "layer_no"), "style", "left")
    i = C("req_id")
    status = F.when(i % 50 == 0, 503).when(i % 101 == 0, 500).when(i % 103 == 0, 302).when(C("result") == "404", 404).when(i % 6 == 0, 304).otherwise(200)
    return d.select("req_id", "z", (i * 37 % 5000).alias("read_us"), F.coalesce("layer_no", F.lit(4)).alias("layer_no"), status.alias("status"), F.when(i % 50 > 0, C("counter")).alias("counter"))


@query("SELECT CASE WHEN status IN (200, 304, 404, 503) THEN CAST(status AS VARCHAR) WHEN status = 500 THEN '5XX' ELSE 'other' END AS class, count(*) AS n FROM outcomes GROUP BY 1")
def resp_counts(v: Views) -> DataFrame:
    s = C("status")
    return outcomes(v).groupBy(F.when(s.isin(200, 304, 404, 503), s.cast("string")).when(s == 500, "5XX").otherwise("other").alias("class")).agg(F.count("*").alias("n"))


@query("SELECT counter, count(*) AS n FROM outcomes WHERE counter IS NOT NULL GROUP BY counter")
def fresh_counts(v: Views) -> DataFrame:
    return outcomes(v).where(C("counter").isNotNull()).groupBy("counter").agg(F.count("*").alias("n"))


@query("SELECT z, count(*) AS n_reads, CAST(sum(read_us) AS BIGINT) AS dur_us FROM outcomes WHERE status = 200 GROUP BY ROLLUP (z)")
def read_timing(v: Views) -> DataFrame:
    return outcomes(v).where("status = 200").rollup("z").agg(F.count("*").alias("n_reads"), F.sum("read_us").alias("dur_us"))


@query("SELECT z, count(*) AS n FROM outcomes WHERE status IN (200, 304) GROUP BY z")
def resp_by_zoom(v: Views) -> DataFrame:
    return outcomes(v).where("status IN (200, 304)").groupBy("z").agg(F.count("*").alias("n"))


@query("SELECT layer_no, count(*) FILTER (WHERE status IN (200, 304)) AS n200, count(*) FILTER (WHERE status = 404) AS n404 FROM outcomes GROUP BY layer_no")
def resp_by_layer(v: Views) -> DataFrame:
    return outcomes(v).groupBy("layer_no").agg(F.count_if(C("status").isin(200, 304)).alias("n200"), F.count_if(C("status") == 404).alias("n404"))


@query("SELECT z, layer_no, count(*) AS n, CAST(sum(read_us) AS BIGINT) AS dur_us FROM outcomes GROUP BY GROUPING SETS ((), (z), (layer_no))")
def serve_rollup(v: Views) -> DataFrame:
    return outcomes(v).groupingSets([[], ["z"], ["layer_no"]], "z", "layer_no").agg(F.count("*").alias("n"), F.sum("read_us").alias("dur_us"))


def _agg(value: str, cond: str) -> str:
    return f"CAST(coalesce(sum({value}) FILTER (WHERE {cond}), 0) AS BIGINT)"


def _metrics() -> list[tuple[str, str]]:
    ok = "status IN (200, 304)"
    m = [(n, _agg("1", f"status = {s}")) for n, s in (("NoResp200", 200), ("NoResp304", 304), ("NoResp404", 404), ("NoResp503", 503), ("NoResp5XX", 500))]
    m += [("NoRespOther", _agg("1", "status NOT IN (200, 304, 404, 503, 500)"))] + [(n, _agg("1", f"counter = '{s}'")) for n, s in K.FRESHNESS]
    m += [(f"NoRespZoom{z:02d}", _agg("1", f"{ok} AND z = {z}")) for z in range(MAX_ZOOM + 1)] + [("NoTileBufferReads", _agg("1", "status = 200")), ("DurationTileBufferReads", _agg("read_us", "status = 200"))]
    for z in range(MAX_ZOOM + 1):
        m += [(f"NoTileBufferReadZoom{z:02d}", _agg("1", f"status = 200 AND z = {z}")), (f"DurationTileBufferReadZoom{z:02d}", _agg("read_us", f"status = 200 AND z = {z}"))]
    for n, uri in LAYERS:
        m += [(f"NoRes200Layer{uri}", _agg("1", f"{ok} AND layer_no = {n}")), (f"NoRes404Layer{uri}", _agg("1", f"status = 404 AND layer_no = {n}"))]
    return m


def _text(items: list[str]) -> str:
    """SQL that numbers text lines given as expressions over one row r."""
    return "SELECT unnest(range(" + str(len(items)) + "))::INT AS line_no, unnest([" + ", ".join(items) + "]) AS line FROM r"


_ROW = "r AS (SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in _metrics()) + " FROM outcomes)"


@query(f"WITH {_ROW} " + _text([f"""concat('{n}: ', "{n}")""" for n, _ in _metrics()]))
def serve_stats_text(v: Views) -> DataFrame:
    return K.lines(*K.serve_counters(outcomes(v), MAX_ZOOM, LAYERS))


def _prom() -> list[str]:
    z = range(MAX_ZOOM + 1)
    out: list[str] = []

    def family(name: str, text: str, samples: list[tuple[str, str]]) -> None:
        out.extend([f"'# HELP {name} {text}'", f"'# TYPE {name} counter'"])
        out.extend(f"concat('{name}{{{labels}}} ', {value})" for labels, value in samples)

    family("tile_server_http_responses_total", "Number of HTTP responses by response code", [(f'status="{s}"', f'"{k}"') for s, k in zip(("200", "304", "404", "503", "5XX", "other"), ("NoResp200", "NoResp304", "NoResp404", "NoResp503", "NoResp5XX", "NoRespOther"), strict=True)])
    names = [k for k, _ in K.FRESHNESS]
    family("tile_server_tiles_total", "Tiles served", [(f'age="{a}",rendered="{h}"', f'"{k}"') for (a, h), k in zip((("fresh", "no"), ("old", "no"), ("outdated", "no"), ("fresh", "yes"), ("old", "attempted"), ("outdated", "attempted")), names, strict=True)])
    family("tile_server_zoom_responses_total", "Tiles served by zoom level", [(f'zoom="{i:02d}"', f'"NoRespZoom{i:02d}"') for i in z])
    family("tile_server_tile_reads_total", "Tiles served from the tile buffer", [(f'zoom="{i:02d}"', f'"NoTileBufferReadZoom{i:02d}"') for i in z])
    family("tile_server_tile_reads_seconds_total", "Tile buffer duration", [(f'zoom="{i:02d}"', f"""printf('%.6f', "DurationTileBufferReadZoom{i:02d}" / 1000000.0)""") for i in z])
    family("tile_server_layer_responses_total", "Layer responses", [(f'layer="{u}",status="{s}"', f'"NoRes{s}Layer{u}"') for _, u in LAYERS for s in (200, 404)])
    return out


@query(f"WITH {_ROW} " + _text(_prom()))
def prom_metrics(v: Views) -> DataFrame:
    return K.prometheus(K.serve_counters(outcomes(v), MAX_ZOOM, LAYERS)[0], MAX_ZOOM, LAYERS)


@query("""
WITH l AS (SELECT concat('NoRespZoom', lpad(CAST(z AS VARCHAR), 2, '0'), ': ', count(*)) AS line FROM tile_requests GROUP BY z)
SELECT string_split(line, ': ')[1] AS name, CAST(string_split(line, ': ')[2] AS BIGINT) AS value FROM l
""")
def counter_parse(v: Views) -> DataFrame:
    """Scraped "name: value" lines as rows."""
    text = v.tile_requests.groupBy("z").agg(F.count("*").alias("n")).select(F.concat(F.lit("NoRespZoom"), F.lpad(C("z").cast("string"), 2, "0"), F.lit(": "), C("n").cast("string")).alias("line"))
    part = F.split("line", ": ")
    return text.select(part[0].alias("name"), part[1].try_cast("bigint").alias("value"))


_BAND = "CASE WHEN z <= 8 THEN 1 WHEN z <= 12 THEN 2 WHEN z <= 14 THEN 3 WHEN z <= 16 THEN 4 WHEN z <= 18 THEN 5 ELSE 6 END"


@query(f"SELECT {_BAND} AS band, count(*) AS n FROM outcomes WHERE status IN (200, 304) GROUP BY 1")
def zoom_bands(v: Views) -> DataFrame:
    return outcomes(v).where("status IN (200, 304)").groupBy(K.band(C("z")).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT z, coalesce(min(render_ms) FILTER (WHERE render_ms > 0), 0) AS min_ms, avg(render_ms) AS avg_ms, max(render_ms) AS max_ms, CAST(sum(render_ms) AS BIGINT) AS total_ms, count(*) AS n FROM tile_requests GROUP BY z")
def latency_by_zoom(v: Views) -> DataFrame:
    """Client latency; a latency of 0 counts as unset for the minimum, which is 0 where all are."""
    ms = C("render_ms")
    return v.tile_requests.groupBy("z").agg(F.coalesce(F.min(F.when(ms > 0, ms)), F.lit(0)).alias("min_ms"), F.avg(ms).alias("avg_ms"), F.max(ms).alias("max_ms"), F.sum(ms).alias("total_ms"), F.count("*").alias("n"))


@query("SELECT CAST(max(maxzoom) AS INT) AS max_zoom, count(*) AS n_layers FROM many_layers")
def layer_extents(v: Views) -> DataFrame:
    return v.many_layers.agg(F.max("maxzoom").alias("max_zoom"), F.count("*").alias("n_layers"))


_GROUP = f"g AS (SELECT poll, coalesce({_BAND}, 0) AS band, CAST(sum(n_reads) AS BIGINT) AS n, CAST(sum(dur_us) AS BIGINT) AS us FROM counter_polls GROUP BY 1, 2 UNION ALL SELECT poll, 0, CAST(sum(n_reads) AS BIGINT), CAST(sum(dur_us) AS BIGINT) FROM counter_polls GROUP BY 1)"


@query(f"""
WITH {_GROUP}, d AS (SELECT poll, band, n - lag(n) OVER w AS dn, us - lag(us) OVER w AS dus FROM g WINDOW w AS (PARTITION BY band ORDER BY poll))
SELECT poll, band, CASE WHEN dn = 0 THEN 0.0 ELSE round(dus / dn / 1000000.0, 9) END AS latency_s FROM d WHERE dn IS NOT NULL
""")
def latency_delta(v: Views) -> DataFrame:
    """Mean latency between polls, in total (band 0) and by band; 0 where nothing was read."""
    g = v.counter_polls.withColumn("band", F.explode(F.array(F.lit(0), K.band(C("z"))))).groupBy("poll", "band").agg(F.sum("n_reads").alias("n"), F.sum("dur_us").alias("us"))
    w = Window.partitionBy("band").orderBy("poll")
    d = g.select("poll", "band", (C("n") - F.lag("n").over(w)).alias("dn"), (C("us") - F.lag("us").over(w)).alias("dus")).where("dn IS NOT NULL")
    return d.select("poll", "band", F.when(C("dn") == 0, 0.0).otherwise(F.round(C("dus") / C("dn") / 1000000.0, 9)).alias("latency_s"))


@query("""
WITH d AS (SELECT poll, z, n_reads - lag(n_reads) OVER w AS dn, date_diff('second', lag(poll) OVER w, poll) AS dt FROM counter_polls WINDOW w AS (PARTITION BY z ORDER BY poll))
SELECT poll, z, CASE WHEN dn >= 0 THEN round(dn / CAST(dt AS DOUBLE), 9) END AS rate FROM d WHERE dn IS NOT NULL
""")
def counter_rate(v: Views) -> DataFrame:
    """Rate of a counter; a reset gives null."""
    w = Window.partitionBy("z").orderBy("poll")
    d = v.counter_polls.select("poll", "z", (C("n_reads") - F.lag("n_reads").over(w)).alias("dn"), W.seconds_between(F.lag("poll").over(w), C("poll")).alias("dt"))
    return d.where("dn IS NOT NULL").select("poll", "z", F.when(C("dn") >= 0, F.round(C("dn") / C("dt"), 9)).alias("rate"))


@query("""
WITH s AS (SELECT event_id, concat('timestamp=', strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'Z') AS line FROM events)
SELECT event_id, date_diff('second', strptime(regexp_extract(line, '^timestamp=(.*)Z$', 1), '%Y-%m-%dT%H:%M:%S'), TIMESTAMP '2024-02-01 00:00:00') AS lag_s FROM s
""")
def replication_lag(v: Views) -> DataFrame:
    line = F.concat(F.lit("timestamp="), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    at = F.translate(F.regexp_extract(line, "^timestamp=(.*)Z$", 1), "T", " ").cast("timestamp_ntz")
    return v.events.select("event_id", W.seconds_between(at, F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")).alias("lag_s"))


@query("""
WITH s AS (SELECT event_id, (event_id * 7919) % 300000 AS s FROM events)
SELECT event_id, CASE WHEN s > 86400 THEN concat(s // 86400, ' day(s) and ', s % 86400 // 3600, ' hour(s)') WHEN s > 3600 THEN concat(s // 3600, ' hour(s)') WHEN s > 60 THEN concat(s // 60, ' minute(s)') ELSE concat(s, ' second(s)') END AS lag FROM s
""")
def lag_human(v: Views) -> DataFrame:
    return v.events.select("event_id", W.lag_text(C("event_id") * 7919 % 300000).alias("lag"))


@query("SELECT req_id, concat(req_id % 1000, ' in ', printf('%.2f', (req_id % 90) / 4.0), ' seconds (', CASE WHEN req_id % 90 = 0 THEN '-' ELSE printf('%.2f', (req_id % 1000) / ((req_id % 90) / 4.0)) END, '/s)') AS line FROM tile_requests")
def display_rate(v: Views) -> DataFrame:
    n, s = C("req_id") % 1000, C("req_id") % 90 / 4.0
    rate = F.when(s == 0, "-").otherwise(F.format_string("%.2f", F.bround(n / F.when(s != 0, s), 2)))
    return v.tile_requests.select("req_id", F.concat(n.cast("string"), F.lit(" in "), F.format_string("%.2f", s), F.lit(" seconds ("), rate, F.lit("/s)")).alias("line"))
