"""Tailing: appended, unfinished, rotated, cut and rewritten files, restarts, pieces; no line lost or doubled."""

import json
import os

import pytest

from logrill.session import fresh_path
from logrill.sources import tail


class Job:
    """A query that is started anew, from its checkpoint, for every batch."""

    def __init__(self, spark, folder, piece_bytes=tail.PIECE_BYTES):
        self.spark, self.folder, self.piece_bytes = spark, folder, piece_bytes
        self.out, self.position = fresh_path(spark, "tail"), fresh_path(spark, "position")

    def lines(self):
        stream = tail.tail_lines(self.spark, str(self.folder), "log*", self.piece_bytes)
        query = (stream.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.position)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        return sorted(r["value"] for r in self.spark.read.schema(stream.schema).parquet(self.out).collect())


def write(path, text, mode="a"):
    with open(path, mode) as f:
        f.write(text)


def test_append_rotate_cut_and_restart(spark, tmp_path):
    log, job = tmp_path / "log", Job(spark, tmp_path)
    write(log, "one\ntwo\n")
    assert job.lines() == ["one", "two"]
    write(log, "three\nunfini")
    assert job.lines() == sorted(["one", "two", "three"])
    write(log, "shed\n\nfive\r\n")
    seen = ["one", "two", "three", "unfinished", "", "five"]
    assert job.lines() == sorted(seen) and job.lines() == sorted(seen)
    write(log, "late\n")  # written before rotation, taken after it, under the new name
    os.rename(log, tmp_path / "log.1")
    write(log, "new one\n")
    write(tmp_path / "other", "not matched\n")
    seen += ["late", "new one"]
    assert job.lines() == sorted(seen)
    write(log, "x\n", "w")  # cut: shorter than what was taken
    seen += ["x"]
    assert job.lines() == sorted(seen)
    write(log, "rewritten and longer than before\n", "w")  # same file, other content
    seen += ["rewritten and longer than before"]
    assert job.lines() == sorted(seen)
    write(log, "end\n")
    os.remove(tmp_path / "log.1")
    assert job.lines() == sorted([*seen, "end"])


@pytest.mark.parametrize("piece_bytes", [1, 7, 100])
def test_pieces_share_no_line(spark, tmp_path, piece_bytes):
    lines = [("é" * (i % 13)) + str(i) for i in range(60)]
    write(tmp_path / "log", "\n".join(lines) + "\n")
    assert Job(spark, tmp_path, piece_bytes).lines() == sorted(lines)


def test_positions_tell_equal_lines_apart(tmp_path):
    write(tmp_path / "log", "a\na\n")
    reader = tail.TailReader(str(tmp_path), "*", 3)
    rows = [r for p in reader.partitions(reader.initialOffset(), reader.latestOffset()) for r in reader.read(p)]
    assert [(v, at) for v, _, at in rows] == [("a", 0), ("a", 2)]


def test_a_file_that_left_with_unread_lines_is_an_error(tmp_path):
    write(tmp_path / "log", "a\n")
    reader = tail.TailReader(str(tmp_path), "*", 100)
    (piece,) = reader.partitions({}, reader.latestOffset())
    os.remove(tmp_path / "log")
    with pytest.raises(FileNotFoundError):
        list(reader.read(piece))


def test_records(spark, tmp_path):
    good = json.dumps({"timestamp": "2024-01-01T00:00:00", "message": "link down", "program": "kernel"})
    write(tmp_path / "log", "\n".join([good, good, "", '{"cut', json.dumps({"program": "p"}),
                                       json.dumps({"message": "veth88671e0: Link DOWN"})]) + "\n")
    out = fresh_path(spark, "records")
    stream = tail.tail_raw(spark, f"file://{tmp_path}")
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "position"))
     .trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.schema(stream.schema).parquet(out).collect()
    assert [r["message"] for r in rows] == ["link down"] * 2 and len({r["event_id"] for r in rows}) == 2
