"""Large files in ranges: every line once, whatever the cuts, and in bounded memory."""

import random
import tracemalloc

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sheavework.sources import files, ranges


def lines_of(path, decoder):
    with ranges.open_file(str(path)) as file:
        size = file.size()
        return [(a, t) for start, stop in decoder.ranges(file, size) for b in decoder.read(file, start, stop) for a, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1 << 20])
@pytest.mark.parametrize("block", [1, 5, 1 << 20])
def test_every_line_once(tmp_path, monkeypatch, size, block):
    monkeypatch.setattr(ranges, "READ_BYTES", block)
    rng = random.Random(size)
    for end in (b"", b"\n"):
        data = b"\n".join(bytes(rng.choice(b"ab\xff\xc3") for _ in range(rng.choice([0, 1, 3, 40]))) for _ in range(60)) + end
        path = tmp_path / "x.txt"
        path.write_bytes(data)
        want, at = [], 0
        for line in data.split(b"\n"):
            if at < len(data):
                want.append((at, line.decode("utf-8", "ignore")))
            at += len(line) + 1
        assert lines_of(path, ranges.TextLines(size)) == want
    path.write_bytes(b"")
    assert lines_of(path, ranges.TextLines(size)) == []


def test_a_large_file_needs_little_memory(tmp_path):
    path = tmp_path / "large.txt"
    with path.open("wb") as out:
        for i in range(1200):
            out.write((f"{i:08d} " + "word " * 8000 + "\n").encode())
    assert path.stat().st_size > 45_000_000
    tracemalloc.start()
    decoder, n = ranges.TextLines(8 << 20), 0
    with ranges.open_file(str(path)) as file:
        for start, stop in decoder.ranges(file, file.size()):
            for batch in decoder.read(file, start, stop):
                n += batch.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1200 and peak < 8 << 20


def test_ranges_go_to_many_tasks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    (tmp_path / "b.txt").write_text("x")
    pq.write_table(pa.table({"k": list(range(100)), "t": [None if i % 7 == 0 else f"v{i}" for i in range(100)]}), tmp_path / "c.parquet", row_group_size=9)
    (tmp_path / "d.parquet").write_bytes(b"no parquet")
    found = files.scan_corpus(spark, str(tmp_path))

    def lines():
        return ranges.TextLines(1000)

    plan = ranges.plan_ranges(found.where("name like '%.txt'"), lines)
    assert plan.where("name = 'a.txt'").count() == -(-(tmp_path / "a.txt").stat().st_size // 1000)
    got = ranges.extract_ranges(plan, lines, "line_start long, text string", tasks=7)
    assert got.rdd.getNumPartitions() == 7
    rows = got.collect()
    assert sorted(r.text for r in rows if r.source == "a.txt") == sorted(f"line {i}" for i in range(5000)) and [r.text for r in rows if r.source == "b.txt"] == ["x"]
    cells = ranges.extract_ranges(ranges.plan_ranges(found.where("name like '%.parquet'"), ranges.ParquetCells), ranges.ParquetCells, "row_no long, col_no int, column_name string, value string").collect()
    assert {(r.row_no, r.column_name, r.value) for r in cells if r.source == "c.parquet"} == {(i, "k", str(i)) for i in range(100)} | {(i, "t", None if i % 7 == 0 else f"v{i}") for i in range(100)}
    assert [r.error.split(":")[0] for r in cells if r.source == "d.parquet"] == ["ArrowInvalid"]
    gone = ranges.extract_ranges(plan.selectExpr("concat(path, '.gone') AS path", "name", "start", "stop", "error"), lines, "line_start long, text string").collect()
    assert all(r.error and r.text is None for r in gone)
