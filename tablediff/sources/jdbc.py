"""Database tables through Spark's JDBC source.

Read-only by construction (Spark's JDBC reader only issues SELECTs). A read replica, when configured, replaces the
primary URL with no fallback, so a broken replica is an ERROR rather than a silent read of the primary.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from ..operators.columns import ColumnSets
from ..spec import RowRange, column_map
from .dialect import Dialect, dialect_named, typed_answer

DEFAULT_FETCH_SIZE = 10_000


@dataclass(frozen=True)
class JdbcConnection:
    url: str
    user: str | None = None
    password: str | None = None
    driver: str | None = None
    replica_url: str | None = None
    fetch_size: int = DEFAULT_FETCH_SIZE
    query_timeout_seconds: int = 30 * 60
    # Bounded parallel reads: at most this many concurrent queries against the source.
    max_partitions: int = 2
    # The database's SQL dialect (see sources/dialect.py): with it the aggregate check runs inside the database and reads
    # are split by its quantiles.
    dialect: str | None = None
    # For a database that has no window functions: split reads into equal steps.
    equal_steps: bool = False
    extra: dict[str, str] = field(default_factory=dict)

    def options(self) -> dict[str, str]:
        opts = {
            "url": self.replica_url or self.url,
            "fetchsize": str(self.fetch_size),
            "queryTimeout": str(self.query_timeout_seconds),
            "pushDownPredicate": "true",
            "pushDownAggregate": "true",
            # A plain TIMESTAMP has no zone, so it can be a key; only zoned types arrive as instants.
            "preferTimestampNTZ": "true",
        }
        if self.user is not None:
            opts["user"] = self.user
        if self.password is not None:
            opts["password"] = self.password
        if self.driver is not None:
            opts["driver"] = self.driver
        opts.update(self.extra)
        return opts


def quote_identifier(name: str) -> str:
    """ANSI double-quoted identifier; names come from a spec and are checked against real metadata first."""
    if not name or "\x00" in name:
        raise ValueError(f"Invalid identifier: {name!r}")
    return '"' + name.replace('"', '""') + '"'


def relation(schema: str, table: str) -> str:
    return f"{quote_identifier(schema)}.{quote_identifier(table)}"


def table_reader_options(
    conn: JdbcConnection,
    schema: str,
    table: str,
    partition_column: str | None = None,
    lower_bound: int | None = None,
    upper_bound: int | None = None,
) -> dict[str, str]:
    """Options for reading one table; with a numeric partition column the read is split into parallel ranges."""
    opts = conn.options()
    opts["dbtable"] = relation(schema, table)
    if partition_column is not None and lower_bound is not None and upper_bound is not None:
        opts.update(
            partitionColumn=quote_identifier(partition_column),
            lowerBound=str(lower_bound),
            upperBound=str(upper_bound),
            numPartitions=str(conn.max_partitions),
        )
    return opts


def query_options(conn: JdbcConnection, query: str) -> dict[str, str]:
    """Options for reading the answer of a query that the database works out itself."""
    return {**conn.options(), "query": query}


# --- exact numbers -------------------------------------------------------------------------------------------------

# java.sql.Types
NUMERIC_TYPES = (2, 3)
MOST_DIGITS = 38


def exact_types(columns: list[tuple[str, int, int | None, int | None]], numbers: frozenset[str] = frozenset()) -> str:
    """Spark's ``customSchema`` for catalogue rows (name, JDBC type, digits, scale), empty if nothing needs saying.

    A number that the catalogue gives no precision for (or more digits than Spark has) would be cut to ten decimals; it
    is read as the database's own text, which is exact and compares so. ``numbers`` (tolerance and range columns) must
    stay numbers and are left as Spark reads them.
    """
    out = []
    for name, kind, digits, scale in columns:
        if kind not in NUMERIC_TYPES or name in numbers:
            continue
        known = digits is not None and scale is not None and 0 < digits <= MOST_DIGITS and 0 <= scale <= digits
        backquoted = "`" + name.replace("`", "``") + "`"
        out.append(f"{backquoted} {f'DECIMAL({digits}, {scale})' if known else 'STRING'}")
    return ", ".join(out)


# --- splitting a read ----------------------------------------------------------------------------------------------


def bound_literal(dialect: Dialect, value) -> str:
    """A value that the database gave, as it is written in a query."""
    if isinstance(value, bool) or value is None:
        raise ValueError(f"no bound: {value!r}")
    if isinstance(value, dt.datetime):
        return dialect.literal(value)
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, (int, Decimal)):
        return dialect.literal(Decimal(value))
    if isinstance(value, float):
        return repr(value)
    return dialect.text_literal(str(value))


def split_predicates(dialect: Dialect, column: str, starts: list) -> list[str]:
    """One condition per stretch of a read: together they hold each row once, rows without a value in the first.

    ``starts`` are where the stretches begin (see ``Dialect.split_query``); the first one takes all that lies below the
    second. A value that fills several stretches gives one.
    """
    x = dialect.name_of(column)
    later = sorted({s for s in starts if s is not None})[1:]
    if not later:
        return ["1 = 1"]
    texts = [bound_literal(dialect, s) for s in later]
    out = [f"({x} < {texts[0]} OR {x} IS NULL)"]
    out += [f"({x} >= {a} AND {x} < {b})" for a, b in zip(texts, texts[1:])]
    return [*out, f"({x} >= {texts[-1]})"]


def bounds_query(schema: str, table: str, column: str, where: str | None = None) -> str:
    """One aggregate query the database answers itself: the range of the column a read is split on."""
    c = quote_identifier(column)
    return f"SELECT MIN({c}), MAX({c}) FROM {relation(schema, table)}" + (f" WHERE {where}" if where else "")


def bounds_options(conn: JdbcConnection, schema: str, table: str, column: str, where: str | None = None) -> dict[str, str]:
    return query_options(conn, bounds_query(schema, table, column, where))


def split_options(conn: JdbcConnection, schema: str, table: str, column: str, lo, hi) -> dict[str, str]:
    """Options reading the table as ``conn.max_partitions`` ranges of ``column`` between the bounds (inclusive)."""
    if isinstance(lo, (int, float, Decimal)) and not isinstance(lo, bool):
        # Numeric bounds are whole numbers for Spark; the upper one is exclusive there.
        return table_reader_options(conn, schema, table, column, math.floor(lo), math.floor(hi) + 1)
    opts = table_reader_options(conn, schema, table)
    opts.update(
        partitionColumn=quote_identifier(column), lowerBound=str(lo), upperBound=str(hi), numPartitions=str(conn.max_partitions)
    )
    return opts


def _range_text(dialect: Dialect, schema_of, rng: tuple[str, RowRange] | None) -> str | None:
    if rng is None:
        return None
    name, bounds = rng
    column = column_map(schema_of).get(name)
    if column is None:
        raise ValueError(f"range column '{name}' does not exist")
    return dialect.row_range(column, bounds)


def read_table(spark: SparkSession, conn: JdbcConnection, schema: str, table: str, types: str = "") -> DataFrame:
    options = table_reader_options(conn, schema, table)
    if types:
        options["customSchema"] = types
    return spark.read.format("jdbc").options(**options).load()


def read_table_split(
    spark: SparkSession,
    conn: JdbcConnection,
    schema: str,
    table: str,
    column: str,
    rng: tuple[str, RowRange] | None = None,
    types: str = "",
) -> DataFrame:
    """The table read as ``conn.max_partitions`` equally full stretches of ``column`` at most.

    The database is asked once where they begin, among the rows of the range (column, bounds) alone, so a narrow range
    of a large table is split as evenly as the whole table. With ``conn.equal_steps`` it is only asked for the ends,
    and Spark cuts what lies between into equal steps.
    """
    dialect = dialect_named(conn.dialect) if conn.dialect else Dialect()
    plain = read_table(spark, conn, schema, table, types)
    where = _range_text(dialect, plain.schema, rng)
    if conn.equal_steps:
        lo, hi = spark.read.format("jdbc").options(**bounds_options(conn, schema, table, column, where)).load().collect()[0]
        if lo is None:
            return plain
        options = split_options(conn, schema, table, column, lo, hi) | ({"customSchema": types} if types else {})
        return spark.read.format("jdbc").options(**options).load()
    query = dialect.split_query(relation(schema, table), column, conn.max_partitions, where)
    starts = [r[0] for r in spark.read.format("jdbc").options(**query_options(conn, query)).load().collect()]
    properties = {k: v for k, v in conn.options().items() if k != "url"}
    if types:
        properties["customSchema"] = types
    return spark.read.jdbc(
        conn.replica_url or conn.url, relation(schema, table), predicates=split_predicates(dialect, column, starts), properties=properties
    )


def read_aggregates(
    spark: SparkSession,
    conn: JdbcConnection,
    schema: str,
    table: str,
    cs: ColumnSets,
    side: str,
    classes: int,
    rng: tuple[str, RowRange] | None = None,
    schema_of=None,
) -> DataFrame:
    """The aggregate check's values per key class, worked out by the database: no row crosses the connection."""
    dialect = dialect_named(conn.dialect)
    query = dialect.aggregate_query(relation(schema, table), cs, _range_text(dialect, schema_of, rng), classes)
    return typed_answer(spark.read.format("jdbc").options(**query_options(conn, query)).load(), cs, side)


# --- the catalogue -------------------------------------------------------------------------------------------------


def _with_catalogue(spark: SparkSession, conn: JdbcConnection, schema: str, table: str, use):
    """``use(metadata, exact names)`` on a connection of its own. An error here (host, login, database) is raised: it says
    nothing about the table."""
    jvm, given = spark.sparkContext._jvm, conn.options()
    if "driver" in given:
        jvm.java.lang.Class.forName(given["driver"], True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    properties = jvm.java.util.Properties()
    for name in ("user", "password", *conn.extra):
        if name in given:
            properties.setProperty(name, given[name])
    link = jvm.java.sql.DriverManager.getConnection(given["url"], properties)
    try:
        meta = link.getMetaData()
        escape = meta.getSearchStringEscape()
        return use(meta, [n.replace(escape, escape * 2).replace("_", escape + "_").replace("%", escape + "%") for n in (schema, table)])
    finally:
        link.close()


def table_exists(spark: SparkSession, conn: JdbcConnection, schema: str, table: str) -> bool:
    """Whether the database's own catalogue lists the table or view."""
    return _with_catalogue(spark, conn, schema, table, lambda meta, names: meta.getTables(None, *names, None).next())


def catalogue_columns(spark: SparkSession, conn: JdbcConnection, schema: str, table: str) -> list[tuple[str, int, int | None, int | None]]:
    """(name, JDBC type, digits, scale) of the table's columns."""

    def read(meta, names):
        rows, found = [], meta.getColumns(None, *names, None)
        while found.next():

            def number(field):
                value = found.getInt(field)
                return None if found.wasNull() else value

            rows.append((found.getString("COLUMN_NAME"), found.getInt("DATA_TYPE"), number("COLUMN_SIZE"), number("DECIMAL_DIGITS")))
        return rows

    return _with_catalogue(spark, conn, schema, table, read)


def read_table_or_none(
    spark: SparkSession,
    conn: JdbcConnection,
    schema: str,
    table: str,
    split_column: str | None = None,
    rng: tuple[str, RowRange] | None = None,
    numbers: frozenset[str] = frozenset(),
) -> DataFrame | None:
    """The table (split on ``split_column`` when given), or None when the database's catalogue does not list it."""
    if not table_exists(spark, conn, schema, table):
        return None
    types = exact_types(catalogue_columns(spark, conn, schema, table), numbers)
    if split_column is not None:
        return read_table_split(spark, conn, schema, table, split_column, rng, types)
    return read_table(spark, conn, schema, table, types)
