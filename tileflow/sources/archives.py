"""Archives of metatile files, for stores of millions: a tree takes an inode and a block for every file and for one or two folders of its own.

The ``.meta`` files of a style and zoom lie in some zip archives in the zoom's folder, as they are and under their places below it, so any
zip tool unpacks them into the tree. The checksum of its place says which archive has a file. Files are not compressed: index and tiles are
read where they lie. A change writes an archive anew beside the old one, from which files that stay are copied one by one, and renames it;
a lock, which ends with its process, keeps writers apart, and readers keep the archive they opened.
"""

from __future__ import annotations

import calendar
import contextlib
import datetime as dt
import fcntl
import os
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Archives of a style and zoom, fixed when a store is made.
SHELVES = 64
#: Extra field of zip files with times (change, access, creation) in 100 ns since 1601.
_TIMES = struct.Struct("<HHIHHQQQ")
_TIMES_ID, _SINCE_1601 = 0x000A, 11_644_473_600_000_000
_FIELD = struct.Struct("<HH")
_LOCAL = 30


def place(path: str) -> tuple[str, str]:
    """(archive, name in it) of a file's path in the tree."""
    folder, *parts = path.rsplit("/", 5)
    name = "/".join(parts)
    return shelf(folder, zlib.crc32(name.encode()) % SHELVES), name


def shelf(folder: str, n: int) -> str:
    return f"{folder}/{n:02}.zip"


def archive(path: Column) -> Column:
    """The archive of a path, as ``place`` has it."""
    part = lambda i: F.regexp_extract(path, "^(.*)/([^/]*(?:/[^/]*){4})$", i)
    return F.concat(part(1), F.lit("/"), F.lpad((F.crc32(part(2).cast("binary")) % SHELVES).cast("string"), 2, "0"), F.lit(".zip"))


class Archive:
    """An archive opened to read. ``members`` are its files by name."""

    def __init__(self, path: str):
        self._file = open(path, "rb")  # noqa: SIM115
        self._zip = zipfile.ZipFile(self._file)
        self.members = self._zip.NameToInfo

    def __enter__(self) -> Archive:
        return self

    def __exit__(self, *_) -> None:
        self._file.close()

    def start(self, info: zipfile.ZipInfo) -> int:
        """Where a file begins."""
        if info.compress_type != zipfile.ZIP_STORED:
            raise ValueError(f"{self._file.name} has {info.filename} compressed")
        fd = self._file.fileno()
        return info.header_offset + _LOCAL + sum(_FIELD.unpack(os.pread(fd, 4, info.header_offset + _LOCAL - 4)))

    def read(self, at: int, n: int) -> bytes:
        return os.pread(self._file.fileno(), n, at)

    def contents(self, info: zipfile.ZipInfo) -> bytes:
        return self.read(self.start(info), info.file_size)


def opened(path: str) -> Archive | None:
    """The archive; None if there is none."""
    try:
        return Archive(path)
    except FileNotFoundError:
        return None


def changed_at(info: zipfile.ZipInfo) -> int:
    """Microseconds since 1970; of archives made elsewhere, their time as if it were UTC."""
    at = 0
    while at + _FIELD.size <= len(info.extra):
        kind, n = _FIELD.unpack_from(info.extra, at)
        if kind == _TIMES_ID and n == _TIMES.size - _FIELD.size:
            return _TIMES.unpack_from(info.extra, at)[5] // 10 - _SINCE_1601
        at += _FIELD.size + n
    return calendar.timegm(info.date_time) * 1_000_000


def _put(new: zipfile.ZipFile, name: str, us: int, blob: bytes) -> None:
    info = zipfile.ZipInfo(name, min(max(time.gmtime(us // 1_000_000)[:6], (1980, 1, 1, 0, 0, 0)), (2107, 12, 31, 23, 59, 58)))
    info.external_attr = 0o644 << 16
    t = (us + _SINCE_1601) * 10
    info.extra = _TIMES.pack(_TIMES_ID, _TIMES.size - _FIELD.size, 0, 1, 24, t, t, t)
    new.writestr(info, blob)


@contextlib.contextmanager
def _locked(path: str) -> Iterator[None]:
    try:
        f = open(f"{path}.lock", "w")  # noqa: SIM115
    except FileNotFoundError:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        f = open(f"{path}.lock", "w")  # noqa: SIM115
    with f:
        fcntl.lockf(f, fcntl.LOCK_EX)
        yield


def aged(seconds: float) -> float:
    """What expiring does to a file's time: back by 20 years, unless it is so old already: before 2006, or 20 years, so that another run of a task
    changes nothing."""
    at = dt.datetime.fromtimestamp(seconds, dt.UTC)
    if at.year <= max(2005, dt.datetime.now(dt.UTC).year - 20):
        return seconds
    leap = at.month == 2 and at.day == 29
    return at.replace(year=at.year - 20, day=28 if leap and (at.year - 20) % 4 else at.day).timestamp()


def change(path: str, rows: Iterator[tuple[str, int | None, bytes | None]], operation: str) -> None:
    """Write, delete or expire the files rows(name, microseconds, contents) of one archive; the first row of a name counts."""
    if operation != "write" and not os.path.exists(path):
        return
    with _locked(path):
        temporary, names = f"{path}.{uuid.uuid4().hex}", set()
        try:
            with zipfile.ZipFile(temporary, "w") as new:
                for name, us, blob in rows:
                    if operation == "write" and name not in names:
                        _put(new, name, time.time_ns() // 1000 if us is None else us, blob)
                    names.add(name)
                if old := opened(path):
                    with old:
                        for name, info in old.members.items():
                            if name not in names:
                                _put(new, name, changed_at(info), old.contents(info))
                            elif operation == "expire":
                                _put(new, name, round(aged(changed_at(info) / 1e6) * 1e6), old.contents(info))
                left = bool(new.filelist)
            if left:
                os.replace(temporary, path)
            elif os.path.exists(path):
                os.remove(path)
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.remove(temporary)
