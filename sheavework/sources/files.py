"""Files as rows: scanning, extracting, CSV and text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import names, text
from ..session import setting


LIST_TASKS = 4  # tasks for each core that list folders


def scan_corpus(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, name, modificationTime, length, content) of every file. Content is only read where it is used.

    Many folders are listed by a few tasks for each core, not by a task for each folder.
    """
    tasks = str(LIST_TASKS * spark.sparkContext.defaultParallelism)
    with setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", tasks):
        files = (
            spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
        )
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1))


def route_by_kind(files: DataFrame, name: str = "name") -> DataFrame:
    return files.withColumn("kind", names.file_kind(F.col(name)))


Extractor = Callable[[str, bytes], pd.DataFrame | Iterator[pd.DataFrame]]
OUT_ROWS = 1 << 15  # rows that leave at a time


def extract(files: DataFrame, extractor: Callable[[], Extractor], schema: str | StructType) -> DataFrame:
    """Decode files with a caller's decoder.

    ``extractor`` is a factory called once per task; it returns a function from (name, bytes) to a frame with
    the columns of ``schema``, or to an iterator of such frames, of which one is held at a time. The result has ``source`` in
    front and ``error`` behind; a file that cannot be decoded gives one row with its error, behind the rows of frames that came
    before. Rows leave in the file's own order, one file at a time.
    """
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    inner = [f.name for f in fields]
    out = StructType().add("source", "string")
    for field in fields:
        out = out.add(field.name, field.dataType, True)
    out = out.add("error", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = extractor()
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                try:
                    found = decode(name, bytes(content))
                    for frame in [found] if isinstance(found, pd.DataFrame) else found:
                        frame = frame[inner]
                        for start in range(0, max(1, len(frame)), OUT_ROWS):
                            got = frame.iloc[start : start + OUT_ROWS].astype(object)
                            got = got.where(got.notna(), None)
                            got.insert(0, "source", name)
                            got["error"] = None
                            yield got
                except Exception as problem:  # noqa: BLE001 - reported per file
                    yield pd.DataFrame([{**dict.fromkeys(["source", *inner]), "source": name, "error": f"{type(problem).__name__}: {problem}"}])

    return files.select("name", "content").mapInPandas(run, out)


def read_csv_text(spark: SparkSession, path: str, header: bool = True, multi_line: bool = False) -> DataFrame:
    """All columns as text, empty fields as the empty string. ``multi_line`` keeps line ends inside quotes, at the price of
    one task per file; without it files are split."""
    read = spark.read.csv(path, header=header, inferSchema=False, multiLine=multi_line, escape='"', nullValue="\u0000", emptyValue="")
    return read.na.fill("")


def lossy_utf8(content: Column) -> Column:
    """UTF-8 text without the bytes that cannot be decoded; a replacement character that is in the text stays.

    That character is written in an escaped form before the undecodable bytes are replaced by it.
    """
    escape, replacement = "﷐", "�"
    raw = content.cast("string")
    kept = F.replace(F.replace(raw, F.lit(escape), F.lit(escape + "0")), F.lit(replacement), F.lit(escape + "1"))
    valid = F.replace(F.make_valid_utf8(kept), F.lit(replacement), F.lit(""))
    return F.replace(F.replace(valid, F.lit(escape + "1"), F.lit(replacement)), F.lit(escape + "0"), F.lit(escape))


def read_text_lossy(files: DataFrame) -> DataFrame:
    """(source, kind, bytes, text) of text and other files; other files that are blank are left out."""
    routed = route_by_kind(files).where(F.col("kind").isin("text", "other"))
    read = routed.select(F.col("name").alias("source"), "kind", F.length("content").cast("long").alias("bytes"), lossy_utf8(F.col("content")).alias("text"))
    return read.where((F.col("kind") == "text") | text.not_blank(F.col("text")))
