"""Decisions of the tile server as single CASE expressions over columns."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tileflow.constants import MAX_LOAD_MISSING, MAX_LOAD_OLD, RENDER_BUCKET, RENDER_TOPUP_US, REQUEST_TIMEOUT, TILE_BUCKET, VERY_OLD_US


@dataclass(frozen=True)
class ServerConfig:
    """Directives of one virtual host, with their defaults."""

    cache_duration_dirty: int = 900
    cache_duration_last_modified_factor: float = 0.0
    cache_duration_low_zoom: int = 518400
    cache_duration_medium_zoom: int = 86400
    cache_duration_minimum: int = 10800
    cache_duration_max: int = 604800
    cache_level_low_zoom: int = 0
    cache_level_medium_zoom: int = 0
    cache_extended_hostname: str = ""
    cache_extended_duration: int = 0
    delaypool_tile_size: int = TILE_BUCKET
    delaypool_tile_rate: int = RENDER_TOPUP_US
    delaypool_render_size: int = RENDER_BUCKET
    delaypool_render_rate: int = RENDER_TOPUP_US
    enable_bulk_mode: bool = False
    enable_dirty_url: bool = True
    enable_status_url: bool = True
    enable_global_stats: bool = True
    enable_tile_throttling: bool = False
    enable_tile_throttling_xforward: int = 0
    max_load_old: int = MAX_LOAD_OLD
    max_load_missing: int = MAX_LOAD_MISSING
    request_timeout: int = REQUEST_TIMEOUT
    request_timeout_priority: int = REQUEST_TIMEOUT
    very_old_us: int = VERY_OLD_US
    tile_dir: str = "/var/cache/tiles"
    renderer_socket: str = "/run/renderer.sock"
    renderer_address: tuple[str, int] | None = None
    #: configuration files to load, and layers added one by one: (base uri, style, type and further arguments)
    config_files: tuple[str, ...] = ()
    added_layers: tuple[tuple[str, ...], ...] = ()

    def throttled(self, tiles: tuple[int, float] | None = None, renders: tuple[int, float] | None = None) -> ServerConfig:
        """With buckets as directives give them: (size, tokens a second)."""
        over: dict = {}
        for name, given in (("tile", tiles), ("render", renders)):
            if given is not None:
                over |= {f"delaypool_{name}_size": given[0], f"delaypool_{name}_rate": top_up_us(given[1])}
        return self.merged(over)

    def merged(self, over: dict) -> ServerConfig:
        """A virtual host's own directives win one by one."""
        unknown = set(over) - set(self.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown directives: {sorted(unknown)}")
        return ServerConfig(**{**self.__dict__, **over})


def top_up_us(rate: float) -> int:
    """Microseconds for one token at ``rate`` tokens a second."""
    if rate <= 0:
        raise ValueError("a rate must be above 0")
    return int(1_000_000 / rate)


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds from a to b, the same in any session time zone."""
    return F.timestamp_diff("SECOND", a, b)


def micros_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b)


def tile_state(size: Column, mtime: Column, planet_ts: Column, now: Column, very_old_us: int) -> Column:
    """missing, current, old or veryold; the size is asked first, so a store's answer for a missing tile does not matter."""
    fresh = mtime >= planet_ts
    return F.when(size < 0, "missing").when(fresh, "current").when(micros_between(mtime, now) < very_old_us, "old").otherwise("veryold")


def serve_decision(state: Column, load: Column, in_time: Column, cfg: ServerConfig, allowed: Column | None = None) -> dict[str, Column]:
    """result (served, stale, 404, 503), the command sent to the renderer, and the freshness counter."""
    denied = F.lit(False) if allowed is None or not cfg.enable_tile_throttling else ~allowed
    aged, missing = state.isin("old", "veryold"), state == "missing"
    busy = aged & (load > cfg.max_load_old)
    full = missing & (load > cfg.max_load_missing)
    own = F.when(state == "old", "RenderLow").when(state == "veryold", "Render").otherwise("RenderPrio")
    sent = F.when(busy | full, "Dirty").otherwise(own)
    if cfg.enable_bulk_mode:
        idle, sent = aged, F.when(aged, None).otherwise(F.lit("RenderBulk"))
    else:
        idle = F.lit(False)
    quiet = denied | (state == "current") | idle
    upper = F.when(state == "old", "OLD").otherwise("VERYOLD")
    result = F.when(denied, "503").when(state == "current", "served").when(idle | busy, "stale").when(full, "404").when(in_time, "served").when(aged, "stale").otherwise("404")
    counter = F.when(denied | idle | full, None).when(state == "current", "FRESH").when(busy, upper).when(in_time, "FRESH_RENDER").when(aged, F.concat(upper, F.lit("_RENDER")))
    return {"result": result, "sent": F.when(~quiet, sent), "counter": counter}


def renders_in_time(state: Column, render_ms: Column, cfg: ServerConfig) -> Column:
    """Whether the renderer answers before the client is let go; missing tiles have a timeout of their own."""
    return render_ms <= F.when(state == "missing", cfg.request_timeout_priority * 1000).otherwise(cfg.request_timeout * 1000)


def min_cache_time(z: Column, cfg: ServerConfig) -> Column:
    return F.when(z <= cfg.cache_level_low_zoom, cfg.cache_duration_low_zoom).when(z <= cfg.cache_level_medium_zoom, cfg.cache_duration_medium_zoom).otherwise(cfg.cache_duration_minimum)


def max_age(state: Column, z: Column, maxzoom: Column, mtime: Column, now: Column, host: Column, u: Column, cfg: ServerConfig) -> Column:
    """Seconds a client may keep the tile; u in [0, 1) spreads expiry."""
    stale = cfg.cache_duration_dirty + F.floor(cfg.cache_duration_dirty / 2.0 * u).cast("long")
    held = F.coalesce(F.floor(seconds_between(mtime, now) * cfg.cache_duration_last_modified_factor).cast("long"), F.lit(0).cast("long"))
    least = F.when(z > maxzoom, 0).otherwise(min_cache_time(z, cfg)).cast("long")
    fresh = F.greatest(least, held) + F.floor(10800 * u).cast("long")
    age = F.least(F.when(state.isin("old", "veryold"), stale).otherwise(fresh), F.lit(cfg.cache_duration_max).cast("long"))
    if not cfg.cache_extended_hostname:
        return age
    return F.when(F.contains(host, F.lit(cfg.cache_extended_hostname)), F.lit(cfg.cache_extended_duration).cast("long")).otherwise(age)


def command_for(urgency: Column, bulk: bool = False) -> Column:
    """Urgency 0..3 as the command sent."""
    if bulk:
        return F.lit("RenderBulk")
    return F.when(urgency == 0, "Dirty").when(urgency == 1, "RenderLow").when(urgency == 2, "Render").otherwise("RenderPrio")


def client_ip(peer: Column, forwarded: Column, mode: int) -> Column:
    """0: the peer, 1: the first address of X-Forwarded-For, 2: its last."""
    if mode == 0:
        return peer
    parts = F.filter(F.split(forwarded, "[, ]+"), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(1 if mode == 1 else -1)), peer)


#: Address below a layer: numbers as scanf reads them, an extension, and what follows one more slash.
ADDRESS = r"^\s*([-+]?\d+)/\s*([-+]?\d+)/\s*([-+]?\d+)\.([a-z]{1,255})(?:/(\S{1,10}))?"
ADDRESS_WITH_OPTIONS = r"^([^/]{1,40})/\s*([-+]?\d+)/\s*([-+]?\d+)/\s*([-+]?\d+)\.([a-z]{1,255})(?:/(\S{1,10}))?"


def route(url: Column, layer: dict[str, Column], with_options: bool = False, cfg: ServerConfig | None = None) -> dict[str, Column]:
    """Handler of a url under its first matching layer, and its address.

    stats, metrics, json, serve, status, dirty; notfound outside the layer's bounds and for /status and /dirty of a server
    that has them switched off; error for statistics that are switched off; declined otherwise.
    """
    cfg = cfg or ServerConfig()
    shift = 1 if with_options else 0
    rest = F.substring(url, F.length(layer["baseuri"]) + 1, F.length(url))
    part = lambda i: F.regexp_extract(rest, ADDRESS_WITH_OPTIONS if with_options else ADDRESS, i + shift)
    number = lambda i: part(i).try_cast("bigint")
    z, x, y, ext, tail = number(1), number(2), number(3), part(4), part(5)
    parsed = F.coalesce(ext != "", F.lit(False))
    across = F.pow(F.lit(2.0), F.least(F.greatest(z, F.lit(0)), F.lit(30))).cast("long")
    inside = (z >= layer["minzoom"]) & (z <= layer["maxzoom"]) & (x >= 0) & (y >= 0) & (x <= across * layer["aspect_x"] - 1) & (y <= across * layer["aspect_y"] - 1)
    handler = (
        F.when(url.startswith("/server_stats"), "stats").when(url.startswith("/metrics"), "metrics").when(layer["baseuri"].isNull(), "declined").when(rest.startswith("tile-layer.json"), "json")
        .when(~parsed | (ext != layer["ext"]), "declined").when(~inside, "notfound").when(tail == "", "serve").when(tail == "status", "status").when(tail == "dirty", "dirty").otherwise("declined")
    )
    off = [name for name, on in (("status", cfg.enable_status_url), ("dirty", cfg.enable_dirty_url)) if not on]
    if off:
        handler = F.when(handler.isin(*off), "notfound").otherwise(handler)
    if not cfg.enable_global_stats:
        handler = F.when(handler.isin("stats", "metrics"), "error").otherwise(handler)
    found = handler.isin("serve", "status", "dirty")
    return {"handler": handler, "z": F.when(found, z).cast("int"), "x": F.when(found, x), "y": F.when(found, y), "options": F.when(found, part(0)) if with_options else F.when(found, F.lit(""))}


def dirty(cfg: ServerConfig) -> dict[str, Column]:
    """Answer to /dirty, and the command that it sends to the renderer."""
    if not cfg.enable_dirty_url:
        return {"result": F.lit("404"), "sent": F.lit(None).cast("string")}
    return {"result": F.lit("ok"), "sent": F.lit(None).cast("string") if cfg.enable_bulk_mode else F.lit("Dirty")}


def body(size: Column, tag: Column, asked: Column) -> dict[str, Column]:
    """Answer to a tile that was read: 200 with its bytes, 304 where the client has it, 404 where nothing is stored."""
    status = F.when(size <= 0, 404).when(asked == tag, 304).otherwise(200)
    return {"status": status, "etag": F.when(size > 0, tag), "n_bytes": F.when(status == 200, size)}


def content_encoding(compressed: Column, accepts: Column) -> dict[str, Column]:
    """gzip where the tile is stored compressed and the client accepts it; else served as it is, with a warning."""
    ok = F.contains(accepts, F.lit("gzip"))
    return {"content_encoding": F.when(compressed & ok, "gzip"), "warned": compressed & ~ok}


def legacy_type(extension: Column) -> dict[str, Column]:
    """Type and origin policy of a layer configured by the old directive."""
    script = extension == "js"
    return {"mime": F.when(script, "text/javascript").otherwise("image/png"), "cors": F.when(script, "*").otherwise("")}


#: The sentences of /status.
STATUS_MISSING, STATUS_HEAD = "No tile could not be found at storage location: ", "Tile is "
STATUS_TAIL = "(Dates might not be accurate. Rendering time might be reset to an old date for tile expiry. Access times might not be updated on all file systems)"


def status_text(state: Column, rendered: Column, accessed: Column, place: Column) -> Column:
    """Text of /status; ``place`` is the tile's storage id, times are printed as yyyy-mm-dd hh:mm:ss."""
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    due = F.when(state.isin("old", "veryold"), "due to be rendered").otherwise("clean")
    found = F.concat(F.lit(STATUS_HEAD), due, F.lit(". Last rendered at "), at(rendered), F.lit(". Last accessed at "), at(accessed), F.lit(". Stored in "), place, F.lit(f"\n\n{STATUS_TAIL}\n"))
    return F.when(state == "missing", F.concat(F.lit(STATUS_MISSING), place, F.lit("\n"))).otherwise(found)


def tilejson(layer: dict[str, Column], hosts: Column, description: Column, attribution: Column) -> Column:
    """TileJSON 2.0.0 of a layer, laid out exactly as clients get it (a fixed value)."""
    tiles = F.array_join(F.transform(hosts, lambda h: F.concat(F.lit('\t\t"'), h, layer["baseuri"], F.lit("{z}/{x}/{y}."), layer["ext"], F.lit('"'))), ",\n")
    head = F.format_string('{\n\t"tilejson": "2.0.0",\n\t"schema": "xyz",\n\t"name": "%s",\n\t"description": "%s",\n\t"attribution": "%s",\n\t"minzoom": %d,\n\t"maxzoom": %d,\n\t"tiles": [\n', layer["style"], description, attribution, layer["minzoom"], layer["maxzoom"])
    return F.concat(head, tiles, F.lit("\n\t]\n}\n"))


def answers(asked: dict[str, Column], got: dict[str, Column]) -> Column:
    """Whether an answer of the renderer names the tile that was asked for."""
    same = F.lit(True)
    for k, c in asked.items():
        same &= c == got[k]
    return same


def cors(policy: Column, origin: Column, method: Column, asks: Column) -> dict[str, Column]:
    """Answer to a cross-origin request: the outcome (pass, preflight, forbidden) and its headers."""
    anyone = policy == "*"
    allowed = anyone | F.contains(policy, origin)
    applies = (policy != "") & origin.isNotNull()
    outcome = F.when(~applies, "pass").when(~allowed, "forbidden").when((method == "OPTIONS") & asks.isNotNull(), "preflight").otherwise("pass")
    ok = applies & allowed
    return {"outcome": outcome, "allow_origin": F.when(ok & anyone, "*").when(ok, origin), "vary": F.when(ok & ~anyone, "Origin"), "max_age": F.when(outcome == "preflight", 604800)}


def etag(body: Column) -> Column:
    return F.concat(F.lit('"'), F.md5(body), F.lit('"'))


def lag_text(seconds: Column) -> Column:
    """A lag for people: days and hours, hours, minutes or seconds."""
    n = lambda d: F.floor(seconds / d).cast("string")
    days = F.concat(n(86400), F.lit(" day(s) and "), F.floor(seconds % 86400 / 3600).cast("string"), F.lit(" hour(s)"))
    return F.when(seconds > 86400, days).when(seconds > 3600, F.concat(n(3600), F.lit(" hour(s)"))).when(seconds > 60, F.concat(n(60), F.lit(" minute(s)"))).otherwise(F.concat(seconds.cast("string"), F.lit(" second(s)")))


def planet_override(text: Column) -> Column:
    """Seconds since 1970 of dd/mm/yyyy, dd/mm/yy or a plain number; null if it is neither."""
    pattern = r"^\s*([-+]?\d+)/\s*([-+]?\d+)/\s*([-+]?\d+)"
    part = lambda i: F.regexp_extract(text, pattern, i).try_cast("int")
    year = part(3)
    year = F.when(year > 100, year - 1900).otherwise(year)
    year = F.when(year < 70, year + 100).otherwise(year) + 1900
    days = F.date_diff(F.make_date(year, part(2), part(1)), F.lit("1970-01-01").cast("date")).cast("long") * 86400
    return F.when(F.regexp_like(text, F.lit(pattern)), days).otherwise(F.regexp_extract(text, r"^\s*([-+]?\d+)", 1).try_cast("bigint"))


def localized_name(names: Column, fallback: Column, languages: str) -> Column:
    """First name that exists in the languages asked for; _ stands for the local name."""
    return F.coalesce(*[fallback if lang == "_" else F.try_element_at(names, F.lit(f"name:{lang}")) for lang in languages.split(",")])


def localized_query(sql: Column, languages: str) -> Column:
    """A layer's table query with its first ",name" replaced by the choice of names."""
    choice = ", ".join("name" if lang == "_" else f"tags->'name:{lang}'" for lang in languages.split(","))
    at = F.locate(",name", sql)
    return F.when(at > 0, F.concat(F.substring(sql, F.lit(1), at - 1), F.lit(f", coalesce({choice}) as name"), F.substring(sql, at + 5, F.length(sql)))).otherwise(sql)


#: What a map's PARAMETERIZE_STYLE can name: a function of (layer's table query, options of the request).
PARAMETERIZE: dict[str, Callable[[Column, str], Column]] = {"language": localized_query}


def parameterized(name: str, sql: Column, options: str) -> Column:
    """The layer's query as the named parameterisation makes it; an unknown name warns and changes nothing."""
    if name not in PARAMETERIZE:
        if name:
            warnings.warn(f"unknown parameterisation: {name}", stacklevel=2)
        return sql
    return PARAMETERIZE[name](sql, options)
