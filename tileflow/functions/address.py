"""Tile addressing as Column expressions: no UDF, so all of it stays in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tileflow.constants import BRITISH_GRID, HASHIDX_SIZE, MAX_ZOOM, MERCATOR, METATILE, PLATE_CARREE, PROJECTIONS


def metatile_origin(x: Column) -> Column:
    """First coordinate of the 8 x 8 block that holds x."""
    return x.bitwiseAND(F.lit(~(METATILE - 1)))


def metatile_slot(x: Column, y: Column) -> Column:
    """Place of a tile in its metatile, x-major."""
    return x.bitwiseAND(F.lit(7)) * METATILE + y.bitwiseAND(F.lit(7))


def tiles_across(z: Column) -> Column:
    """2 ** z as a long; null where z is outside 0..30."""
    return F.when(z.between(0, 30), F.expr("1L") * F.pow(F.lit(2.0), z).cast("long"))


def path_bytes(x: Column, y: Column) -> list[Column]:
    """The five directory numbers of a metatile, most significant first."""
    mx, my = metatile_origin(x), metatile_origin(y)
    nibble = lambda c, i: F.shiftright(c, 4 * i).bitwiseAND(F.lit(15))
    return [nibble(mx, i) * 16 + nibble(my, i) for i in (4, 3, 2, 1, 0)]


def hashed_path(tile_dir: Column, style: Column, z: Column, x: Column, y: Column, options: Column | None = None) -> Column:
    stem = F.concat_ws("/", tile_dir, style, z.cast("string"), *[b.cast("string") for b in path_bytes(x, y)])
    tail = F.lit(".meta") if options is None else F.when(options == "", F.lit(".meta")).otherwise(F.concat(F.lit("."), options, F.lit(".meta")))
    return F.concat(stem, tail)


def parse_path(tile_dir: str, path: Column) -> dict[str, Column]:
    """style, z, x, y of a hashed path and a code: 0 valid, 1 not such a path, 2 a number over 255, 3 outside the zoom."""
    found = parsed_path(tile_dir, path)[0]
    return {c: found[c] for c in ("style", "z", "x", "y", "code")}


def parsed_path(tile_dir: str, path: Column) -> Column:
    """An array of one, (style, z, x, y, code) as ``parse_path`` has them. A path is matched once, not anew for each number: what is used
    often is the element that a function gets by name."""
    rest = F.when(path.startswith(tile_dir), F.substring(path, len(tile_dir) + 1, 4096))
    pattern = r"^/([^/]{1,40})/\s*([-+]?\d+)/\s*([-+]?\d+)/\s*([-+]?\d+)/\s*([-+]?\d+)/\s*([-+]?\d+)/\s*([-+]?\d+)"
    parts = F.when(F.regexp_like(rest, F.lit(pattern)), F.split(F.regexp_replace(rest, f"(?s){pattern}.*$", "$1/$2/$3/$4/$5/$6/$7"), "/"))

    def numbers(p: Column) -> Column:
        h = [p[i].cast("long") for i in range(2, 7)]
        x = reduce(lambda a, b: a * 16 + F.shiftright(b, 4).bitwiseAND(F.lit(15)), h, F.lit(0).cast("long"))
        y = reduce(lambda a, b: a * 16 + b.bitwiseAND(F.lit(15)), h, F.lit(0).cast("long"))
        over = reduce(lambda a, b: a | (b < 0) | (b > 255), h, F.lit(False))
        return F.struct(p[0].alias("style"), p[1].cast("int").alias("z"), x.alias("x"), y.alias("y"), over.alias("over"))

    def checked(n: Column) -> Column:
        code = F.when(n["style"].isNull(), 1).when(n["over"], 2).when(~valid_xyz(n["x"], n["y"], n["z"]), 3).otherwise(0)
        return F.struct(n["style"].alias("style"), n["z"].alias("z"), *[F.when(~n["over"], n[c]).alias(c) for c in ("x", "y")], code.alias("code"))

    return F.transform(F.transform(F.array(parts), numbers), checked)


def store_keys(style: Column, z: Column, x: Column, y: Column, options: Column) -> dict[str, Column]:
    """Keys of one tile in each kind of store."""
    s = lambda c: c.cast("string")
    mx, my = metatile_origin(x), metatile_origin(y)
    tail = F.when(options == "", F.lit(".meta")).otherwise(F.concat(F.lit("."), options, F.lit(".meta")))
    return {
        "memcached_key": F.concat(F.concat_ws("/", style, s(mx), s(my), s(z)), tail),
        "rados_key": F.concat(F.concat_ws("/", style, s(z), s(mx), s(my)), tail),
        "proxy_path": F.concat(F.concat_ws("/", s(z), s(x), s(y)), F.lit(".png")),
    }


def lon_to_x(lon: Column, z: Column) -> Column:
    return F.floor((lon + 180.0) / 360.0 * F.pow(F.lit(2.0), z)).cast("long")


def lat_to_y(lat: Column, z: Column) -> Column:
    r = lat * F.pi() / 180.0
    return F.floor((1.0 - F.ln(F.tan(r) + 1.0 / F.cos(r)) / F.pi()) / 2.0 * F.pow(F.lit(2.0), z)).cast("long")


def ll_to_pixel(lon: Column, lat: Column, z: Column) -> tuple[Column, Column]:
    """Pixel at 256 pixels a tile, sine of the latitude clamped to +-0.9999."""
    c = F.pow(F.lit(2.0), z) * 256.0
    f = F.least(F.greatest(F.sin(lat * F.pi() / 180.0), F.lit(-0.9999)), F.lit(0.9999))
    px = F.round(c / 2.0 + lon * (c / 360.0))
    py = F.round(c / 2.0 - 0.5 * F.ln((1.0 + f) / (1.0 - f)) * (c / (2.0 * F.pi())))
    return px.cast("long"), py.cast("long")


def pixel_to_ll(px: Column, py: Column, z: Column) -> tuple[Column, Column]:
    c = F.pow(F.lit(2.0), z) * 256.0
    g = (py - c / 2.0) / -(c / (2.0 * F.pi()))
    return (px - c / 2.0) / (c / 360.0), (2.0 * F.atan(F.exp(g)) - 0.5 * F.pi()) * 180.0 / F.pi()


def projection(srs: Column) -> dict[str, Column]:
    """Bounds and aspect of a projection string; an unknown one is taken as mercator."""
    kind = F.when(F.contains(srs, F.lit(MERCATOR)), "mercator").when(srs == PLATE_CARREE, "plate_carree").when(srs == BRITISH_GRID, "british_grid").otherwise("mercator")
    out = {}
    for i, name in enumerate(("bound_x0", "bound_y0", "bound_x1", "bound_y1", "aspect_x", "aspect_y")):
        c = F.lit(None)
        for k, v in PROJECTIONS.items():
            c = F.when(kind == k, F.lit(v[i])).otherwise(c)
        out[name] = c
    return out


def tile_bounds(p: dict[str, Column], x: Column, y: Column, z: Column) -> dict[str, Column]:
    """Projected box of the metatile that begins at (x, y), and the tiles it has each way."""
    n = F.pow(F.lit(2.0), z)
    nx, ny = p["aspect_x"] * n, p["aspect_y"] * n
    tx, ty = F.least(F.lit(8.0), nx), F.least(F.lit(8.0), ny)
    w, h = p["bound_x1"] - p["bound_x0"], p["bound_y1"] - p["bound_y0"]
    return {
        "minx": p["bound_x0"] + w * (x / nx), "miny": p["bound_y1"] - h * ((y + ty) / ny),
        "maxx": p["bound_x0"] + w * ((x + tx) / nx), "maxy": p["bound_y1"] - h * (y / ny),
        "tiles_x": tx.cast("int"), "tiles_y": ty.cast("int"),
    }


def relevel(x: Column, z: Column, to: Column) -> Column:
    """Coordinate of the ancestor, or of the top-left descendant, at zoom ``to``."""
    up, down = F.greatest(z - to, F.lit(0)), F.greatest(to - z, F.lit(0))
    return F.floor(x / F.pow(F.lit(2.0), up)).cast("long") * F.pow(F.lit(2.0), down).cast("long")


def queue_hash(style: Column, z: Column, mx: Column, my: Column) -> Column:
    letters = F.aggregate(F.split(style, ""), F.lit(0).cast("long"), lambda a, c: a + F.ascii(c))
    low = F.lit(0xFFFFFF)
    key = letters.bitwiseAND(F.lit(0x1FF)) * (1 << 52) + z.cast("long") * (1 << 48) + mx.bitwiseAND(low) * (1 << 24) + my.bitwiseAND(low)
    return key % HASHIDX_SIZE


def valid_xyz(x: Column, y: Column, z: Column, *, aspect_x: Column | int = 1, aspect_y: Column | int = 1, minzoom: Column | int = 0, maxzoom: Column | int = MAX_ZOOM) -> Column:
    n = F.pow(F.lit(2.0), z).cast("long")
    fits = (x >= 0) & (y >= 0) & (x <= n * aspect_x - 1) & (y <= n * aspect_y - 1)
    return F.coalesce((z >= minzoom) & (z <= maxzoom) & fits, F.lit(False))
