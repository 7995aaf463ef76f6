import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheavework.operators import select as S
from sheavework.sources import files
from sheavework.streaming import ingest

ALLOWED = [
    "SELECT * FROM t", "select 1;  ", "WITH a AS (SELECT 1 AS x) SELECT * FROM a", "SELECT id, count(*) FROM t GROUP BY id HAVING count(*) > 0 ORDER BY 1 LIMIT 3",
    "SELECT * FROM t WHERE id IN (SELECT id FROM t) UNION ALL SELECT 1", "SELECT (SELECT max(id) FROM t) AS m", "SELECT * FROM range(3)", "SELECT * FROM (VALUES (1), (2)) v(a)",
    "SELECT row_number() OVER w FROM t WINDOW w AS (ORDER BY id)", "SELECT * FROM t LATERAL VIEW explode(array(1, 2)) x AS y", "SELECT id FROM t INTERSECT ALL SELECT 1",
    "SELECT 'drop table t; insert into x' AS harmless",
]
REFUSED = [
    "INSERT INTO t VALUES (1)", "DROP TABLE t", "CREATE TABLE x AS SELECT 1", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT TRANSFORM (id) USING 'cat' FROM t",
    "SELECT * FROM (SELECT TRANSFORM (id) USING 'cat' FROM t)", "SELECT java_method('java.lang.System', 'getenv')", "SELECT reflect('a', 'b')", "SELECT max(reflect('a', 'b')) OVER () FROM t",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`", "SELECT * FROM t WHERE EXISTS (SELECT * FROM csv.`/x`)", "WITH a AS (SELECT * FROM text.`/x`) SELECT * FROM a",
    "SELECT 1; SELECT 2", "SHOW TABLES", "SET spark.x = 1", "DELETE FROM t", "UPDATE t SET id = 1", "DESCRIBE t", "EXPLAIN SELECT 1", "CACHE TABLE t", "TRUNCATE TABLE t", "REFRESH TABLE t",
    "CREATE TEMP VIEW v AS SELECT 1", "MERGE INTO t USING u ON t.id = u.id WHEN MATCHED THEN DELETE", "not sql", "", "EXECUTE IMMEDIATE 'DROP TABLE t'",
]


@pytest.fixture(scope="module", autouse=True)
def view(spark):
    spark.range(5000).createOrReplaceTempView("t")


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(spark, sql):
    S.select(spark, sql).collect()


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, sql):
    with pytest.raises(S.Refused):
        S.select(spark, sql)


def test_cap_and_errors(spark):
    assert S.select(spark, "SELECT * FROM t").count() == 1000
    assert S.select(spark, "SELECT * FROM t LIMIT 7").count() == 7
    assert S.select(spark, "SELECT * FROM t", None).count() == 5000
    df, error = S.select_or_error(spark, "SELECT missing FROM t")
    assert df is None and "missing" in error
    assert S.select_or_error(spark, "DROP TABLE t")[0] is None


def test_lossy_text(spark):
    cases = [b"ab\xff\xfec", "d�e﷐f﷐1".encode(), b"\xe2\x82", b"\xf0\x9f\x98x", b"", "é".encode() + b"\xc3"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(cases)], "i int, c binary")
    got = {r.i: r.t for r in df.select("i", files.lossy_utf8(F.col("c")).alias("t")).collect()}
    assert got == {i: b.decode("utf-8", errors="ignore") for i, b in enumerate(cases)}


def test_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"one \xfftwo")
    (tmp_path / "sub" / "b.bin").write_bytes(b" \n")
    (tmp_path / "c.csv").write_text('x,y\n"1,5",\n"say ""q""","l\nm"\n')
    found = files.route_by_kind(files.scan_corpus(spark, str(tmp_path)))
    assert {(r.name, r.kind, r.length) for r in found.collect()} == {("a.txt", "text", 8), ("b.bin", "other", 2), ("c.csv", "csv", len((tmp_path / "c.csv").read_bytes()))}
    read = files.read_text_lossy(found)
    assert [(r.source, r.text) for r in read.collect()] == [("a.txt", "one two")]
    table = files.read_csv_text(spark, str(tmp_path / "c.csv"), multi_line=True)
    assert [tuple(r) for r in table.collect()] == [("1,5", ""), ('say "q"', "l\nm")]

    def extractor():
        def decode(name, content):
            if name == "b.bin":
                raise ValueError("unknown format")
            return pd.DataFrame({"n": [len(content)], "first": [content[:1].decode()]})

        return decode

    got = {r.source: r for r in files.extract(found, extractor, "n long, first string").collect()}
    assert got["a.txt"].n == 8 and got["a.txt"].error is None and got["b.bin"].n is None and "unknown format" in got["b.bin"].error


def test_stream_rerun_adds_nothing(spark, tmp_path):
    schema = "source string, kind string, page int, text string"
    first = spark.createDataFrame([("a.txt", "text", 1, "x " * 400), ("b.txt", "text", 1, "y")], schema)
    second = spark.createDataFrame([("b.txt", "text", 1, "y"), ("c.txt", "text", 1, "z")], schema)
    src, table = str(tmp_path / "in"), str(tmp_path / "chunks")
    first.coalesce(1).write.parquet(src)

    def run(no, progress):
        stream = spark.readStream.schema(schema).parquet(src)
        ingest.stream_ingest(stream, table, str(tmp_path / progress), run_no=no).awaitTermination()
        return sorted((r.source, r.chunk_no) for r in spark.read.parquet(table).collect())

    assert run(0, "p0") == [("a.txt", 0), ("a.txt", 1), ("b.txt", 0)]
    assert run(0, "p0") == [("a.txt", 0), ("a.txt", 1), ("b.txt", 0)]
    second.coalesce(1).write.mode("append").parquet(src)
    assert run(0, "p0") == [("a.txt", 0), ("a.txt", 1), ("b.txt", 0), ("c.txt", 0)]
    assert len(run(1, "p1")) == 4


def test_stream_batches_do_not_read_the_store(spark, tmp_path):
    schema = "source string, kind string, page int, text string"
    src, table, progress = str(tmp_path / "in"), str(tmp_path / "chunks"), str(tmp_path / "p")
    # Overlapping inputs: every batch brings one source that came before, under the same id with another text.
    for no in range(4):
        rows = [(f"s{i}.txt", "text", 1, f"{'abcd'[no]} {i % 10}") for i in range(20 * no - (no > 0), 20 * no + 20)]
        rows += [("twice.txt", "text", 1, t) for t in ("zz", "aa")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        (tmp_path / "kept").mkdir(exist_ok=True)
        if no == 2:  # what was stored is out of reach, and still known
            (tmp_path / "chunks").rename(tmp_path / "kept" / "chunks")
        ingest.stream_ingest(stream, table, progress, groups=8).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "kept" / "chunks")).drop("run_no", "batch_no").unionByName(spark.read.parquet(table).drop("run_no", "batch_no")).collect()
    assert sorted(r.source for r in got) == sorted([f"s{i}.txt" for i in range(80)] + ["twice.txt"])
    assert {r.source: r.text for r in got}["twice.txt"] == "aa" and {r.source: r.text for r in got}["s19.txt"] == "a 9"


def test_stream_catalog(spark, tmp_path):
    schema = "source string, kind string, n int"
    src, table = str(tmp_path / "in"), str(tmp_path / "docs")
    for part in ([("a", "csv", 1), ("a", "xls", 2)], [("a", "pdf", 1), ("b", "csv", 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        ingest.stream_catalog_upsert(stream, table, str(tmp_path / "p"), ["source"], [F.col("n").desc()]).awaitTermination()
    assert {(r.source, r.kind) for r in ingest.current_catalog(spark, table, ["source"]).collect()} == {("a", "pdf"), ("b", "csv")}
    compacted = ingest.compact_catalog(spark, table, str(tmp_path / "docs2"), ["source"])
    assert compacted.count() == 2


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    """Forty folders, which used to be a task each; the session's own setting is back afterwards."""
    from sheavework.sources import files

    for i in range(40):
        (tmp_path / f"name={i}").mkdir()
        (tmp_path / f"name={i}" / "a.txt").write_text(str(i))
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.sparkContext.setJobGroup("listing", "listing")
    found = files.scan_corpus(spark, str(tmp_path), "*.txt")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("listing")
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in jobs for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert all(n <= files.LIST_TASKS * spark.sparkContext.defaultParallelism for n in tasks) and max(tasks, default=0) < 40
    assert spark.conf.get(name) == before
    assert sorted(r.content for r in found.select("content").collect()) == sorted(str(i).encode() for i in range(40))
