"""Large files in ranges: a file is cut where its format allows it, and each range is decoded by a task of its own.

    found = plan_ranges(scan_corpus(spark, path), TextLines)
    rows = extract_ranges(found, TextLines, "line_start long, text string")

A range decoder opens the file itself and reads only its range, batch by batch, so neither a file nor a range has to fit in a
task. Planning is a job like any other: every file's ranges are found by the task that holds its row, not by the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RANGE_BYTES = 32 << 20
READ_BYTES = 1 << 20
RANGES = "path string, name string, start long, stop long, error string"


class RangeDecoder(Protocol):
    """What a format has to say: where its files may be cut, and what a range holds."""

    def ranges(self, file: pa.NativeFile, size: int) -> Iterator[tuple[int, int]]: ...

    def read(self, file: pa.NativeFile, start: int, stop: int) -> Iterator[pa.RecordBatch]: ...


def open_file(path: str) -> pa.NativeFile:
    """For reading at any place; local files and the stores that Arrow knows (hdfs, s3, gs)."""
    filesystem, inside = pyarrow.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return filesystem.open_input_file(inside)


class TextLines:
    """Lines of text files with the place of their first byte: (line_start long, text string). A range has the lines that begin in it.

    Bytes that are no UTF-8 are dropped. A line longer than a range is read by the range that it begins in.
    """

    def __init__(self, range_bytes: int = RANGE_BYTES) -> None:
        self.range_bytes = range_bytes

    def ranges(self, file: pa.NativeFile, size: int) -> Iterator[tuple[int, int]]:
        for start in range(0, size, self.range_bytes):
            yield start, min(size, start + self.range_bytes)

    def read(self, file: pa.NativeFile, start: int, stop: int) -> Iterator[pa.RecordBatch]:
        at = start
        if start:  # the line that begins before the range, or at its very end, is another's
            file.seek(start - 1)
            at = start - 1
            while True:
                block = file.read(READ_BYTES)
                cut = block.find(b"\n")
                if cut >= 0 or not block:
                    break
                at += len(block)
            at = at + cut + 1 if block else stop
        if at >= stop:
            return
        file.seek(at)
        held: list[bytes] = []  # the beginning of a line that goes on in the next block
        while at < stop:
            block = file.read(READ_BYTES)
            if block and b"\n" not in block:
                held.append(block)
                continue
            lines = (b"".join(held) + block).split(b"\n")
            rest = lines.pop()
            held = [rest]
            starts, texts = [], []
            for line in lines if block else [rest] if rest else []:
                if at >= stop:
                    break
                starts.append(at)
                texts.append(line.decode("utf-8", "ignore"))
                at += len(line) + 1
            if starts:
                yield pa.RecordBatch.from_arrays([pa.array(starts), pa.array(texts)], names=["line_start", "text"])
            if not block:
                return


class ParquetCells:
    """Cells of Parquet files, a range per row group: (row_no long, col_no int, column_name string, value string).

    ``show`` turns an Arrow column into text; by default Arrow's own conversion.
    """

    def __init__(self, show: Callable[[pa.Array], pa.Array] | None = None, rows: int = 4096) -> None:
        self.show, self.rows = show or (lambda column: column.cast(pa.string())), rows

    def ranges(self, file: pa.NativeFile, size: int) -> Iterator[tuple[int, int]]:
        for group in range(pyarrow.parquet.ParquetFile(file).num_row_groups):
            yield group, group + 1

    def read(self, file: pa.NativeFile, start: int, stop: int) -> Iterator[pa.RecordBatch]:
        parquet = pyarrow.parquet.ParquetFile(file, pre_buffer=False)
        row = sum(parquet.metadata.row_group(g).num_rows for g in range(start))
        for batch in parquet.iter_batches(self.rows, row_groups=range(start, stop)):
            numbers = pa.array(range(row, row + batch.num_rows), pa.int64())
            for place, name in enumerate(batch.schema.names):
                columns = [numbers, pa.repeat(pa.scalar(place, pa.int32()), batch.num_rows), pa.repeat(name, batch.num_rows), self.show(batch.column(place))]
                yield pa.RecordBatch.from_arrays(columns, names=["row_no", "col_no", "column_name", "value"])
            row += batch.num_rows


def plan_ranges(files: DataFrame, decoder: Callable[[], RangeDecoder]) -> DataFrame:
    """(path, name, start, stop, error): the ranges of every file of ``scan_corpus``, or why it has none. Contents are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = decoder()
        for batch in batches:
            rows = []
            for path, name, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    with open_file(path) as file:
                        rows += [(path, name, a, b, None) for a, b in plan.ranges(file, size)]
                except Exception as problem:  # noqa: BLE001 - reported per file
                    rows.append((path, name, None, None, f"{type(problem).__name__}: {problem}"))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "name", "start", "stop", "error"])

    return files.select("path", "name", "length").mapInArrow(run, RANGES)


def extract_ranges(ranges: DataFrame, decoder: Callable[[], RangeDecoder], schema: str | StructType, tasks: int | None = None) -> DataFrame:
    """(source, the columns of ``schema``, error): what the decoder reads from every range, range by range and batch by batch.

    Ranges are dealt out evenly, so the ranges of one large file go to many tasks. A range that fails gives a row with its error
    behind the rows that were read before.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    inner = [f.name for f in fields]
    out = StructType().add("source", "string")
    for field in fields:
        out = out.add(field.name, field.dataType, True)
    out = out.add("error", "string")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = decoder()

        def failed(name: str, problem: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name if f.name == "source" else problem if f.name == "error" else None], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for path, name, start, stop, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if error is not None:
                    yield failed(name, error)
                    continue
                try:
                    with open_file(path) as file:
                        for got in read.read(file, start, stop):
                            n = got.num_rows
                            columns = [pa.repeat(name, n), *[got.column(c).cast(arrow.field(c).type) for c in inner], pa.nulls(n, pa.string())]
                            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
                except Exception as problem:  # noqa: BLE001 - reported per range
                    yield failed(name, f"{type(problem).__name__}: {problem}")

    dealt = ranges.select("path", "name", "start", "stop", "error")
    spread = dealt.repartition(tasks or int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("path", "start"))
    return spread.mapInArrow(run, out)
