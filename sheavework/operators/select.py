"""Read-only SQL over the stored tables."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import wide_view

ROW_CAP = 1000
DEFAULT_QUERY = "SELECT table_name, source, page, sheet FROM kb_tables LIMIT 100"

# Plan nodes and functions that are no plain reading of registered tables.
READ_NODES = {
    "Project", "Filter", "Join", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "SubqueryAlias",
    "Union", "Intersect", "Except", "Intersect All", "Except All", "UnresolvedWith", "UnresolvedRelation", "UnresolvedInlineTable", "OneRowRelation",
    "UnresolvedHaving", "WithWindowDefinition", "Generate", "LateralJoin", "Pivot", "Unpivot", "UnresolvedSubqueryColumnAliases",
    "UnresolvedHint", "Sample", "Window", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "LocalRelation", "AsOfJoin",
    "UnresolvedOrdinal", "ParameterizedQuery", "CTERelationRef", "WithCTE", "ResolvedInlineTable",
}
REFUSED_FUNCTIONS = {"java_method", "reflect", "try_reflect", "raise_error", "read_files"}


class Refused(ValueError):
    """The statement is not a plain SELECT."""


def _children(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _check(spark: SparkSession, plan) -> None:
    name = plan.nodeName()
    if name not in READ_NODES:
        raise Refused(f"Read-only: {name} is not allowed, only SELECT statements are")
    if name == "UnresolvedRelation" and plan.multipartIdentifier().size() > 1:
        first = plan.multipartIdentifier().apply(0)
        if first.lower() not in ("spark_catalog", "global_temp") and not spark.catalog.databaseExists(first):
            raise Refused("Read-only: files cannot be read by path")
    for expression in _children(plan.expressions()):
        _check_expression(spark, expression)
    if name == "UnresolvedWith":
        for relation in _children(plan.cteRelations()):
            _check(spark, relation._2())
    for child in _children(plan.children()):
        _check(spark, child)


def _check_expression(spark: SparkSession, expression) -> None:
    kind = expression.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        parts = expression.nameParts()
        if parts.apply(parts.size() - 1).lower() in REFUSED_FUNCTIONS:
            raise Refused(f"Read-only: function {parts.apply(parts.size() - 1)} is not allowed")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
        if kind == "InSubquery":
            _check_expression(spark, expression.query())
        else:
            _check(spark, expression.plan())
    for child in _children(expression.children()):
        _check_expression(spark, child)


def check_select(spark: SparkSession, sql: str) -> None:
    """Raise ``Refused`` unless the whole parsed statement only reads tables, views and CTEs."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";").rstrip())
    except Exception as problem:
        raise Refused(f"Read-only: cannot be parsed as one SELECT statement: {str(problem).splitlines()[0]}") from problem
    _check(spark, plan)


def select(spark: SparkSession, sql: str, limit: int | None = ROW_CAP) -> DataFrame:
    """Result of one SELECT (or WITH ... SELECT), at most ``limit`` rows as in the console; None for all rows.

    Anything else is refused by its parsed plan, before analysis.
    """
    check_select(spark, sql)
    result = spark.sql(sql.strip().rstrip(";").rstrip())
    return result if limit is None else result.limit(limit)


def select_or_error(spark: SparkSession, sql: str, limit: int | None = ROW_CAP) -> tuple[DataFrame | None, str | None]:
    """The result, or the text of the error."""
    try:
        return select(spark, sql, limit), None
    except (Refused, PySparkException) as problem:
        return None, str(problem)


def register_views(catalog: dict[str, DataFrame], rows: DataFrame | None = None, table_names: list[str] | None = None) -> list[str]:
    """Temporary views of the catalog tables and of the named stored tables; returns the names.

    Wide views are made for the tables that are asked for, not for all: each needs its catalog entry.
    """
    for name, df in catalog.items():
        df.createOrReplaceTempView(name)
    for table in table_names or []:
        wide_view(rows, catalog["kb_columns"], table).createOrReplaceTempView(table)
    return [*catalog, *(table_names or [])]


def list_tables(tables: DataFrame) -> DataFrame:
    """First 100 registered tables."""
    return tables.select("table_name", "source", "page", "sheet").orderBy(F.col("created_at"), "table_name").limit(100)
