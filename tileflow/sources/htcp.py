"""Purge datagrams for HTTP caches, built from columns; all integers most significant byte first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int16(c: Column | int) -> Column:
    c = c if isinstance(c, Column) else F.lit(c)
    return F.unhex(F.lpad(F.hex(c.cast("long")), 4, "0"))


def purge(url: Column) -> Column:
    """A CLR request for a url: length, version 0.0, data length, opcode 4, transaction 255, reason, then HEAD, url, HTTP/1.1 and no headers."""
    n = F.octet_length(url)
    head = [int16(n + 34), F.lit(b"\0\0"), int16(n + 30), F.lit(b"\4\0"), F.lit(b"\0\0\0\xff"), F.lit(b"\0\0")]
    return F.concat(*head, int16(4), F.lit(b"HEAD"), int16(n), F.encode(url, "UTF-8"), int16(8), F.lit(b"HTTP/1.1"), int16(0))
