"""Small text files in any store that Spark reaches."""

from __future__ import annotations

import hashlib
import io
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from glob import glob
from typing import BinaryIO

from pyspark.sql import SparkSession

CHUNK = 1 << 22


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


@contextmanager
def writing(spark: SparkSession, path: str) -> Iterator[Callable[[bytes], None]]:
    """Gives a function that appends to a new file.  It is written under another name and then renamed, so that no reader sees half of it."""
    fs, p = _fs(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(part, True)
    try:
        yield lambda content: out.write(bytearray(content))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(part, p)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    with writing(spark, path) as out:
        out(content)


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path on a mounted file system, which Python reads and writes itself, on executors too; None for other stores."""
    fs, p = _fs(spark, path)
    uri = p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def mounted(uri: str) -> str:
    """The path of a file: URI as Spark shows it."""
    return re.sub("^file:/+", "/", uri)


def put(path: str, content: bytes) -> None:
    """A file of a mounted file system, whole or not at all; for executors."""
    folder, name = os.path.split(path)
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(content)
    os.replace(part, path)
    if os.path.exists(crc := f"{folder}/.{name}.crc"):  # Hadoop's sum of a file that was there before
        os.remove(crc)


class _Stream(io.RawIOBase):
    """Bytes of a file in any store, a chunk at a time."""

    def __init__(self, spark: SparkSession, path: str):
        fs, p = _fs(spark, path)
        self.stream = fs.open(p)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        raw = bytes(self.stream.readNBytes(len(into)))
        into[: len(raw)] = raw
        return len(raw)

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


def opened(spark: SparkSession, path: str) -> BinaryIO:
    """A file to read from start to end, of which no more than a chunk is held."""
    own = local_path(spark, path)
    return open(own, "rb") if own else io.BufferedReader(_Stream(spark, path), CHUNK)


class Hashed:
    """What is read through it, summed up."""

    def __init__(self, source: BinaryIO):
        self.source, self.sum = source, hashlib.sha256()

    def read(self, size: int = -1) -> bytes:
        raw = self.source.read(size)
        self.sum.update(raw)
        return raw


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``; a local session without it gets a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="celestile-")
    path = f"{top}/celestile-tables/{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def read_start(spark: SparkSession, path: str, at: int, size: int, packed: bool = False) -> bytes:
    """Up to ``size`` bytes from ``at`` on; of a gzip file, of what it unpacks to."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        if packed:
            stream = spark._jvm.java.util.zip.GZIPInputStream(stream)
            stream.skipNBytes(at)
        else:
            stream.seek(min(at, fs.getFileStatus(p).getLen()))
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def matching(spark: SparkSession, path: str) -> list[str]:
    """The files that a path names: itself, those of a folder, or of a pattern."""
    shown = lambda name: not name.startswith(("_", "."))
    own = local_path(spark, path)
    if own and not set("[]{}\\") & set(own):
        found = [x for top in glob(own) for x in ([e.path for e in os.scandir(top) if e.is_file()] if os.path.isdir(top) else [top])]
        return sorted(f"file:{x}" for x in found if shown(os.path.basename(x)))
    fs, p = _fs(spark, path)
    out = []
    for s in fs.globStatus(p) or []:
        inner = fs.listStatus(s.getPath()) if s.isDirectory() else [s]
        out += [x.getPath().toString() for x in inner if not x.isDirectory() and shown(x.getPath().getName())]
    return sorted(out)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
