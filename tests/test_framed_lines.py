import io
import random

import pytest

from wirelog.sources.framed_lines import FramedLines, framed
from wirelog.sources.readers import read_lines


@pytest.mark.parametrize("seed", range(20))
def test_every_split_gives_each_line_once(seed):
    draw = random.Random(seed)
    whole = bytes(draw.choice(b"ab\n\r\0") for _ in range(draw.choice([0, 1, 7, 200])))
    lines = whole.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    for split in (1, 2, 3, 10, 1000):
        for block in (1, 4, 1 << 20):
            found = []
            for start in range(0, len(whole), split):
                found += framed(io.BytesIO(whole), start, min(start + split, len(whole)), 5, block)
            assert [(v, n) for v, n, _ in found] == [(line[:5], len(line)) for line in lines]
            assert all(whole[p : p + len(v)] == v for v, _, p in found)


class Counting(io.BytesIO):
    read_bytes = 0

    def read(self, size=-1):
        data = super().read(size)
        self.read_bytes += len(data)
        return data


def test_a_range_inside_a_line_reads_no_farther_than_its_end():
    file = Counting(b"x" * 100_000)
    assert list(framed(file, 10_000, 20_000, 5, 1000)) == [] and file.read_bytes <= 11_000


def test_an_endless_line_is_one_reject(spark, tmp_path):
    """Three gigabytes without a break (a sparse file) between two lines."""
    path = tmp_path / "endless"
    with open(path, "wb") as file:
        file.write(b"first\r\n")
        file.seek(3 << 30)
        file.write(b"\nlast")
    messages, rejects = read_lines(spark, str(tmp_path), max_line=100, bounded=True)
    assert sorted(bytes(r.payload) for r in messages.collect()) == [b"first", b"last"]
    assert [(r.reason, len(r.data)) for r in rejects.collect()] == [("line_too_long", 102)]


def test_bounded_lines_equal_the_text_reader(spark, tmp_path):
    draw = random.Random(1)
    for name in ("a.txt", "b.txt", "_hidden"):
        lines = [bytes(draw.choice(b"xyz\xff\0\r") for _ in range(draw.randrange(30))) for _ in range(300)]
        (tmp_path / name).write_bytes(b"\n".join(lines))
    (tmp_path / "empty").write_bytes(b"")
    for reserved in ("keep", "reject"):
        tables = [read_lines(spark, str(tmp_path), max_line=20, reserved=reserved, bounded=b) for b in (False, True)]
        for plain, bounded, column in zip(*tables, ("payload", "data")):
            rows = [sorted(bytes(r[column])[:20] for r in t.collect()) for t in (plain, bounded)]
            assert rows[0] == rows[1] and rows[0]


def test_small_splits_in_spark(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"".join(b"%d\n" % n for n in range(5000)))
    spark.dataSource.register(FramedLines)
    lines = spark.read.format("framed_lines").option("split_bytes", 1000).load(str(tmp_path / "x"))
    assert sorted(int(bytes(r.value)) for r in lines.collect()) == list(range(5000))
    with pytest.raises(ValueError):
        read_lines(spark, str(tmp_path), bounded=True, streaming=True)
