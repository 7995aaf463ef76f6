"""Rows that hold search tokens: one scan of the stored rows with an automaton per table, built from what is wanted there.

What is wanted, (table, token) pairs with their queries, is measured and sent to the rows; past a bound in bytes it is divided by
hash and the rows are scanned once per part. Rows are never shuffled, and a text is walked once, whatever its length and
however many tokens are wanted.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Collection, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spread import BROADCAST_BYTES, settled
from .workers import lean

PAIR_BYTES = 64  # what a pair takes in a task beside its texts
LIVE_TABLES = 64  # tables whose automata a task keeps
LIVE_ROWS = 1 << 14  # token sets of rows that a task remembers the queries of
OUT_ROWS = 1 << 18  # (query, row) pairs of one result batch


def row_text(values: str = "values") -> Column:
    """All cells of a row in lower case, one per line. A token holds no whitespace, so it cannot reach over a line end."""
    return F.lower(F.array_join(F.filter(values, lambda v: v.isNotNull()), "\n"))


class Tokens:
    """Numbers of the tokens that a text holds: their places in ``tokens``, or of these the numbers in ``some``."""

    def __init__(self, tokens: list[str], some: Collection[int] | None = None) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        numbers = range(len(tokens)) if some is None else some
        for number in numbers:
            self.automaton.add_word(tokens[number], number)
        self.size = len(numbers)
        if self.size:
            self.automaton.make_automaton()

    def find(self, text: str) -> frozenset[int]:
        return frozenset(number for _, number in self.automaton.iter(text)) if self.size else frozenset()


class FirstRows:
    """The rows of one table that are among the first ``n`` seen of some token.

    Once a token has its n rows, later ones cannot be among the first: it leaves the automaton, which is built again
    whenever half of its tokens are done. Rows that come out of order, before a row that is kept, meet all tokens.
    """

    def __init__(self, tokens: list[str], n: int) -> None:
        self.tokens, self.n = tokens, n
        self.kept: dict[int, list[int]] = {}
        self.all = self.open = Tokens(tokens)
        self.full: set[int] = set()  # tokens with n rows
        self.closing = 0  # how many of them the open automaton still holds
        self.edge = -1  # from here on no token outside the open automaton can take a row

    def take(self, row_no: int, text: str) -> list[int]:
        hits = []
        for token in (self.open if row_no >= self.edge else self.all).find(text):
            rows = self.kept.setdefault(token, [])
            if len(rows) < self.n or row_no < rows[-1]:
                insort(rows, row_no)
                del rows[self.n :]
                hits.append(token)
                if len(rows) == self.n and token not in self.full:
                    self.full.add(token)
                    self.closing += 1
        if self.closing and 2 * self.closing >= self.open.size:
            self.open = Tokens(self.tokens, [t for t in range(len(self.tokens)) if t not in self.full])
            self.edge = max(self.kept[t][-1] for t in self.full) + 1
            self.closing = 0
        return hits


class _Recent(dict):
    """The last few values, made where they are missing."""

    def __init__(self, make: Callable, size: int) -> None:
        super().__init__()
        self.make, self.size = make, size

    def __missing__(self, key):
        if len(self) >= self.size:
            self.pop(next(iter(self)))
        self[key] = made = self.make(key)
        return made


class Wanted:
    """What is wanted of each table, from ``pairs`` in the order of table and token. A table's tokens become Python objects when it is asked for,
    so that a task, which reads a range of the rows, holds those of the few tables it meets."""

    def __init__(self, pairs: pa.Table) -> None:
        names = pairs.column("table_name").combine_chunks().dictionary_encode("encode")
        starts = np.flatnonzero(np.diff(names.indices.to_numpy(), prepend=-1))
        ends = np.append(starts[1:], pairs.num_rows)
        self.places = dict(zip(names.take(pa.array(starts)).to_pylist(), zip(starts.tolist(), ends.tolist(), strict=True), strict=True))
        self.tokens = pairs.column("token")

    def of(self, name: str) -> tuple[list[str], np.ndarray]:
        """The distinct tokens of a table, and where the pairs of each begin, with the end behind."""
        start, end = self.places[name]
        tokens = self.tokens.slice(start, end - start).combine_chunks().dictionary_encode("encode")
        firsts = np.flatnonzero(np.diff(tokens.indices.to_numpy(), prepend=-1))
        return tokens.dictionary.to_pylist(), np.append(firsts, end - start) + start


def _parts(wanted: DataFrame, deal_by: str, limit: int) -> Iterator[pa.Table]:
    """``wanted`` in tables of about ``limit`` bytes, dealt by hash of a column, each in the order of table and token."""
    stored = settled(wanted)
    texts = [F.octet_length(F.col(c).cast("string")) for c in stored.columns]
    measured = stored.agg(F.sum(reduce(Column.__add__, texts) + PAIR_BYTES)).first()[0] or 0
    parts = max(1, -(-measured // limit))
    for part in range(parts):
        some = stored if parts == 1 else stored.where(F.pmod(F.xxhash64(deal_by), F.lit(parts)) == part)
        yield some.orderBy("table_name", "token").toArrow()


def _names(rows: DataFrame, pairs: pa.Table) -> DataFrame:
    """(table_name), given as an Arrow table: a list would start further Python workers beside every executor."""
    return rows.sparkSession.createDataFrame(pa.table({"table_name": pairs.column("table_name").unique().cast(pa.string())}), "table_name string")


def _of_tables(rows: DataFrame, pairs: pa.Table, *columns: str | Column) -> DataFrame:
    """The rows of the tables that are wanted. Their names are part of the measured pairs."""
    return rows.join(F.broadcast(_names(rows, pairs)), "table_name", "left_semi").select(*columns)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _nothing(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def rows_of_queries(rows: DataFrame, asked: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, table_name, row_no): each row of ``rows`` (table_name, row_no, values) for every query that wants a token it holds.

    ``asked`` (query_id, table_name, token) has distinct rows. A query's rows come from one part of ``asked`` only, and a row is read by one
    task, so nothing is found twice and nothing has to be brought together.
    """
    schema = f"query_id {_kind(asked, 'query_id')}, table_name string, row_no {_kind(rows, 'row_no')}"
    found = [_rows_of_part(rows, pairs, schema) for pairs in _parts(asked, "query_id", limit) if pairs.num_rows]
    return reduce(DataFrame.unionByName, found) if found else _nothing(rows, schema)


def _rows_of_part(rows: DataFrame, pairs: pa.Table, schema: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = sent.value
        ids, numbers = np.unique(np.array(pairs.column("query_id").to_pylist(), dtype=object), return_inverse=True)
        ids = pa.array(ids.tolist(), pairs.schema.field("query_id").type)
        wanted = Wanted(pairs)

        def met(name: str) -> tuple[Tokens, np.ndarray]:
            tokens, places = wanted.of(name)
            return Tokens(tokens), places

        tables = _Recent(met, LIVE_TABLES)

        def queries_of(key: tuple) -> np.ndarray:
            name, tokens = key
            places = tables[name][1]
            return np.unique(np.concatenate([numbers[places[t] : places[t + 1]] for t in tokens]))

        queries = _Recent(queries_of, LIVE_ROWS)
        for batch in batches:
            at, found, held = [], [], 0

            def told() -> pa.RecordBatch:
                places = pa.array(np.repeat(at, [len(f) for f in found]))
                picked = [ids.take(pa.array(np.concatenate(found))), batch.column(0).take(places), batch.column(1).take(places)]
                return pa.RecordBatch.from_arrays(picked, names=["query_id", "table_name", "row_no"])

            for i, (name, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                tokens = tables[name][0].find(text)
                if tokens:
                    at.append(i)
                    found.append(queries[name, tokens])
                    held += len(found[-1])
                    if held > OUT_ROWS:
                        yield told()
                        at, found, held = [], [], 0
            if held:
                yield told()

    return _of_tables(rows, pairs, "table_name", "row_no", row_text().alias("text")).mapInArrow(lean(run), schema)


def first_rows(rows: DataFrame, wanted: DataFrame, n: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(table_name, row_no, values, tokens): rows that may be among the first ``n`` of the listed tokens, and the tables' rows with
    a number below ``n``, whose tokens may be none. ``wanted`` (table_name, token) has distinct rows.

    A task gives at most n rows per table and token if it reads rows in order; all that are among the first n overall are in it.
    With ``wanted`` in several parts a row may come once for each.
    """
    schema = f"table_name string, row_no {_kind(rows, 'row_no')}, values {_kind(rows, 'values')}, tokens array<string>"
    found = [_first_of_part(rows, pairs, n, schema) for pairs in _parts(wanted, "token", limit) if pairs.num_rows]
    return reduce(DataFrame.unionByName, found) if found else _nothing(rows, schema)


def _first_of_part(rows: DataFrame, pairs: pa.Table, n: int, schema: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Wanted(sent.value)
        # A table that leaves and comes again starts anew, which only gives more rows to choose from.
        seen = _Recent(lambda name: FirstRows(wanted.of(name)[0], n), LIVE_TABLES)
        for batch in batches:
            at, tokens = [], []
            for i, (name, row_no, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                table = seen[name]
                hits = table.take(row_no, text)
                if hits or row_no < n:
                    at.append(i)
                    tokens.append([table.tokens[t] for t in hits])
            if at:
                few = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), few.column(3), pa.array(tokens, pa.list_(pa.string()))], names=["table_name", "row_no", "values", "tokens"])

    return _of_tables(rows, pairs, "table_name", "row_no", row_text().alias("text"), "values").mapInArrow(lean(run), schema)
