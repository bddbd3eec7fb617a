"""Tailing of log files that grow, rotate and are cut, as a streaming source.

Spark's file source takes a file once and never sees what is appended. This
source's offset is, for each file of a folder, its inode, how many bytes have
been taken, and a checksum of its first bytes. So a renamed file goes on where
it was, a new file under an old name begins at its start, and a file that was
cut or written anew is told by its size or by its first bytes. Only whole lines
are taken. The offset lives in the query's checkpoint, so a restart neither
loses nor repeats a line; long stretches are read by several tasks.

The folder must be one that the driver and all executors have mounted.
"""

import fnmatch
import os
import zlib
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from logrill.functions.text import IGNORE_MESSAGE_PATTERN
from logrill.model import RAW
from logrill.sources.raw import usable

HEAD_BYTES = 256  # first bytes that tell one content of a file from another
PIECE_BYTES = 64 << 20  # what one task reads
CHUNK = 1 << 16


def _files(folder: str, pattern: str) -> dict[int, str]:
    """Inode and path of each file."""
    found = {}
    with os.scandir(folder) as entries:
        for e in entries:
            if e.is_file() and fnmatch.fnmatch(e.name, pattern):
                found[e.inode()] = e.path
    return found


def _head(path: str, length: int) -> int:
    with open(path, "rb") as f:
        return zlib.crc32(f.read(length))


def _whole_lines(path: str) -> int:
    """Bytes up to and with the last line end."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at:
            low = max(0, at - CHUNK)
            f.seek(low)
            place = f.read(at - low).rfind(b"\n")
            if place >= 0:
                return low + place + 1
            at = low
    return 0


class Piece(InputPartition):
    """Lines that begin in [low, high) of a file."""

    def __init__(self, folder: str, pattern: str, inode: int, low: int, high: int, end: int):
        self.folder, self.pattern, self.inode, self.low, self.high, self.end = folder, pattern, inode, low, high, end


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str, piece_bytes: int):
        self.folder, self.pattern, self.piece_bytes = folder, pattern, piece_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for inode, path in _files(self.folder, self.pattern).items():
            try:
                at = _whole_lines(path)
                length = min(HEAD_BYTES, at)
                found[str(inode)] = {"at": at, "head": _head(path, length), "length": length}
            except FileNotFoundError:  # gone since the listing
                continue
        return found

    def partitions(self, start: dict, end: dict):
        pieces = []
        paths = _files(self.folder, self.pattern)
        for inode, to in end.items():
            taken = start.get(inode, {"at": 0, "head": 0, "length": 0})
            low = taken["at"]
            path = paths.get(int(inode))
            # a replay compares the first bytes as they were planned, not as they are now
            same = to["head"] == taken["head"] if to["length"] == taken["length"] else (
                path is not None and _head(path, taken["length"]) == taken["head"])
            if to["at"] < low or not same:
                low = 0
            for at in range(low, to["at"], self.piece_bytes):
                pieces.append(Piece(self.folder, self.pattern, int(inode), at, min(at + self.piece_bytes, to["at"]), to["at"]))
        return pieces

    def read(self, piece: Piece):
        path = _files(piece.folder, piece.pattern).get(piece.inode)
        if path is None:
            raise FileNotFoundError(f"the file with inode {piece.inode} has left {piece.folder} with lines that were not read")
        with open(path, "rb") as f:
            at = piece.low
            if at:  # the line that holds the byte before belongs to the piece before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            else:
                f.seek(0)
            while at < piece.high:
                line = f.readline(piece.end - at)
                if not line.endswith(b"\n"):
                    break
                yield line[:-1].decode("utf-8", "replace").removesuffix("\r"), piece.inode, at
                at += len(line)

    def commit(self, end: dict) -> None:
        """Nothing is held that a commit could free."""


class LineTail(DataSource):
    """Options: path, pattern (names of files, rotated ones included), pieceBytes."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "value string, inode long, position long"

    def streamReader(self, schema) -> TailReader:
        url = urlparse(self.options["path"])
        if url.scheme not in ("", "file"):
            raise ValueError("only files of a mounted folder can be tailed")
        return TailReader(url.path, self.options.get("pattern", "*"), int(self.options.get("pieceBytes", PIECE_BYTES)))


def tail_lines(spark: SparkSession, folder: str, pattern: str = "*", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """A stream of (value, inode, position), one row per line of the folder's files."""
    spark.dataSource.register(LineTail)
    return (spark.readStream.format("line_tail").option("pattern", pattern).option("pieceBytes", piece_bytes)
            .option("path", folder).load())


def tail_raw(spark: SparkSession, folder: str, pattern: str = "*",
             ignore_pattern: str = IGNORE_MESSAGE_PATTERN) -> DataFrame:
    """A stream of records from JSON lines as they are appended; see raw.stream_raw for whole files.

    event_id tells equal lines apart by the place where they stand. `pattern`
    must match the names that rotation gives, but not copies of a file.
    """
    lines = tail_lines(spark, folder, pattern)
    record = F.from_json("value", RAW + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = lines.where(F.trim("value") != "").select(
        F.xxhash64("value", "inode", "position").alias("event_id"), record.alias("_r")).select("event_id", "_r.*")
    return usable(parsed, ignore_pattern)
