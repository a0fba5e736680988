"""Request frames in SQL expressions: little-endian integers and zero-padded strings of 41 bytes.

ver, cmd, x, y, z as 32-bit integers; from version 2 the style; from version 3 mimetype and
options; then zeros up to a multiple of four. Decoding reads fixed offsets and stays in
generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tileflow.constants import COMMANDS

TEXT = 41
OFFSETS = {"ver": 0, "cmd": 4, "x": 8, "y": 12, "z": 16, "style": 20, "mimetype": 20 + TEXT, "options": 20 + 2 * TEXT}


def int32(c: Column) -> Column:
    """Four bytes, least first."""
    h = F.lpad(F.hex(c.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def read_int32(b: Column, at: Column | int) -> Column:
    """Signed 32-bit integer at a byte offset (from 0)."""
    at = at if isinstance(at, Column) else F.lit(at)
    byte = lambda i: F.conv(F.hex(F.substring(b, at + i + 1, F.lit(1))), 16, 10).cast("long")
    value = byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)


def text(c: Column) -> Column:
    """At most 40 bytes, then zeros."""
    return F.unhex(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, TEXT - 1)), 2 * TEXT, "0"))


def read_text(b: Column, at: int) -> Column:
    h = F.hex(F.substring(b, at + 1, TEXT))
    return F.decode(F.unhex(F.regexp_extract(h, "^((?:(?!00)..)*)", 1)), "UTF-8")


def code_of(cmd: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, n in COMMANDS.items():
        out = F.when(cmd == n, F.lit(k)).otherwise(out)
    return out


def name_of(code: Column) -> Column:
    """Command of a number on the wire; null for others."""
    names = F.create_map(*[F.lit(v) for k, n in COMMANDS.items() for v in (k, n)])
    return F.try_element_at(names, code.cast("int"))


def submissions(metatiles: DataFrame) -> DataFrame:
    """metatiles(.., style, z, x, y) as batch tools submit them: bulk commands in version 2 of the protocol."""
    return metatiles.withColumns({"ver": F.lit(2), "cmd": F.lit("RenderBulk")})


def encode(cmd: Column, x: Column, y: Column, z: Column, style: Column, mimetype: Column, options: Column, ver: int = 3) -> Column:
    parts = [int32(F.lit(ver)), int32(code_of(cmd)), int32(x), int32(y), int32(z)]
    if ver > 1:
        parts.append(text(style))
    if ver > 2:
        parts += [text(mimetype), text(options)]
    parts.append(F.unhex(F.lit("00" * (-(20 + TEXT * (0, 0, 1, 3)[ver]) % 4))))
    return F.concat(*parts)


def decode(frames: DataFrame) -> DataFrame:
    """frames(.., frame) -> with ver, cmd, x, y, z, style, mimetype, options; absent fields are null."""
    b = F.col("frame")
    long = F.length(b)
    out = {k: read_int32(b, OFFSETS[k]) for k in ("ver", "x", "y")}
    out["z"] = read_int32(b, OFFSETS["z"]).cast("int")
    out["cmd"] = name_of(read_int32(b, OFFSETS["cmd"]))
    out |= {k: F.when(long >= OFFSETS[k] + TEXT, read_text(b, OFFSETS[k])) for k in ("style", "mimetype", "options")}
    return frames.select(*[c for c in frames.columns if c != "frame"], *[c.alias(k) for k, c in out.items()])


def upgraded(requests: DataFrame) -> DataFrame:
    """Requests of older versions with the fields they lack; other versions are rejected."""
    v = F.col("ver")
    known = v.isin(1, 2, 3)
    return requests.withColumns({
        "style": F.when(v == 1, "default").when(known, F.col("style")), "mimetype": F.when(v < 3, "image/png").when(known, F.col("mimetype")),
        "options": F.when(v < 3, "").when(known, F.col("options")), "rejected": ~known,
    })
