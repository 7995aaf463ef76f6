"""Queries meet the texts of the inventories that they ask for."""

from sheavework.operators import search


def test_every_query_gets_the_blocks_of_its_inventory(spark):
    queries = spark.createDataFrame([("a", "columns of a.xlsx"), ("b", "list every sheet"), ("c", "hello"), ("d", "fields of z.xls"), ("e", None)], "query_id string, query string")
    blocks = spark.createDataFrame([("a.xlsx", 0, "A0"), ("a.xlsx", 1, "A1"), ("*", 0, "all")], "report_key string, block_no long, text string")
    got = search.inventory_for_queries(queries, blocks).collect()
    assert sorted((r.query_id, r.wants_inventory, r.workbook, r.block_no, r.text) for r in got if r.query_id != "e") == [
        ("a", True, "columns of a.xlsx", 0, "columns of a.xlsx — sheets: (none)"), ("b", True, None, 0, "all"), ("c", False, None, None, None), ("d", True, "fields of z.xls", 0, "fields of z.xls — sheets: (none)")]
    assert [(r.wants_inventory, r.block_no, r.text) for r in got if r.query_id == "e"] == [(None, None, None)]
    quoted = spark.createDataFrame([("q", 'columns of "a.xlsx"')], queries.schema)
    assert sorted((r.block_no, r.text) for r in search.inventory_for_queries(quoted, blocks).collect()) == [(0, "A0"), (1, "A1")]
