"""Files by ranges of bytes against their plain lines."""
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from annolytics.sources import files as B

PATHS = "path string, offset long"


class Counting(io.BytesIO):
    """A file that counts the bytes it gives."""
    taken = 0

    def readline(self, size=-1):
        line = super().readline(size)
        self.taken += len(line)
        return line


def _bytes(rnd, n):
    return b"".join(rnd.choice([b"", b"x", "é文".encode(), b"long " * rnd.randrange(40), b"cr\r"]) + b"\n" for _ in range(n)) + rnd.choice([b"", b"unfinished"])


def _lines(data, since):
    """(at, next, text) of the finished lines from an offset on."""
    at, made = 0, []
    for line in io.BytesIO(data):
        if line.endswith(b"\n") and at >= since:
            made.append((at, at + len(line), line.rstrip(b"\r\n").decode()))
        at += len(line)
    return made


@pytest.mark.parametrize("block", [1, 3, 64, 10**6])
def test_each_line_belongs_to_the_range_it_begins_in(block):
    rnd = random.Random(block)
    for _ in range(30):
        data = _bytes(rnd, rnd.randrange(12))
        since = rnd.randrange(len(data) + 1)
        got = [(at, at + len(x), x.rstrip(b"\r\n").decode()) for a in range(since, len(data), block)
               for at, x in B.lines_between(io.BytesIO(data), a, min(a + block, len(data)))]
        assert got == _lines(data, since)


def test_only_bytes_behind_the_offset_are_read():
    data = b"0123456789\n" * 10_000
    stream = Counting(data)
    assert len(list(B.lines_between(stream, 11 * 9_990, len(data)))) == 10
    assert stream.taken == 11 * 10 + 1


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_new_lines_of_files_and_where_to_go_on(spark, tmp_path, block):
    rnd = random.Random(5)
    texts = {f"f{i}": _bytes(rnd, 40) for i in range(6)} | {"empty": b"", "open": b"no end"}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    path = {name: f"file:{tmp_path}/{name}" for name in texts}
    since = {"f1": 0, "f2": len(texts["f2"]) // 2, "f3": len(texts["f3"]), "f4": len(texts["f4"]) + 1, "f5": None}
    offsets = spark.createDataFrame([(path[n], o) for n, o in since.items()] + [("file:/gone", 5)], PATHS)
    lines = B.new_file_lines(spark, str(tmp_path), offsets, block)
    starts = {n: 0 if (since.get(n) or 0) > len(d) else since.get(n) or 0 for n, d in texts.items()}
    want = sorted((path[n], *x) for n, d in texts.items() for x in _lines(d, starts[n]))
    assert sorted(tuple(r) for r in lines.collect()) == want
    ranges = B.byte_ranges(B.list_files(spark, str(tmp_path)), offsets, block)
    assert ranges.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] == sum(len(d) - starts[n] for n, d in texts.items())
    # what was read is not read again; what is written later is
    offsets = spark.createDataFrame(B.next_offsets(lines).collect(), PATHS)
    with open(tmp_path / "f0", "ab") as f:
        f.write(b"\nnew\n")
    more = B.new_file_lines(spark, str(tmp_path), offsets, block).filter(F.col("path") == path["f0"]).collect()
    assert more[-1].raw == "new" and len(more) == 2


def test_fingerprints_of_files_that_are_not_empty(spark, tmp_path):
    (tmp_path / "a b").write_bytes(b"x" * (3 << 20))
    (tmp_path / "none").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in B.file_fingerprints(spark, str(tmp_path)).collect()}
    want = {f.name: (f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in tmp_path.iterdir() if f.name != "none"}
    assert got == want
