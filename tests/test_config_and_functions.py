import datetime as dt
from decimal import Decimal

import duckdb
from pyspark.sql import types as T

from tablediff.functions.canonical import canonical, col, fingerprint
from tablediff.functions.types import Category, ColumnInfo, category_of, columns_of
from tablediff.operators.schema import schema_differences
from tablediff.sources.jdbc import JdbcConnection, quote_identifier, table_reader_options
from tablediff.spec import ComparisonSpec, Location, RowRange, config_problems

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("body", T.BinaryType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("zoned", T.TimestampType()),
        T.StructField("amount", T.DecimalType(12, 2)),
    ]
)


def spec(**kw):
    base = dict(name="t", candidate=Location(path="stg/t"), baseline=Location(path="prod/t"), key_columns=("id",), full_refresh=True)
    base.update(kw)
    return ComparisonSpec(**base)


def problems(s, cand=SCHEMA, base=SCHEMA, rng=None, pipeline="p"):
    return config_problems(pipeline, [s], {s.name: (cand, base)}, rng)


def test_categories():
    cats = {c.name: c.category for c in columns_of(SCHEMA)}
    assert cats == {
        "id": Category.NUMERIC, "name": Category.TEXT, "day": Category.DATE, "body": Category.OTHER,
        "tags": Category.OTHER, "zoned": Category.TIMESTAMP_TZ, "amount": Category.NUMERIC,
    }
    assert category_of(T.TimestampNTZType()) is Category.TIMESTAMP
    assert category_of(T.BooleanType()) is Category.OTHER


def test_non_comparable_columns_must_be_ignored():
    p = problems(spec())
    assert any("t.body" in x and "ignored" in x for x in p)
    assert any("t.tags" in x for x in p)
    assert problems(spec(ignored_columns=("body", "tags"))) == []


def test_key_rules():
    ok = ("body", "tags")
    assert any("unfit for a key" in x for x in problems(spec(key_columns=("zoned",), ignored_columns=ok)))
    assert any("both key and ignored" in x for x in problems(spec(key_columns=("id",), ignored_columns=ok + ("id",))))
    assert any("t.nope" in x for x in problems(spec(key_columns=("nope",), ignored_columns=ok)))
    assert any("keyless" in x for x in problems(spec(key_columns=("id",), keyless=True, ignored_columns=ok)))
    assert any("not keyless" in x for x in problems(spec(key_columns=(), ignored_columns=ok)))


def test_tolerance_rules():
    ok = ("body", "tags")
    assert any("without numbers" in x for x in problems(spec(tolerances={"name": "0.1"}, ignored_columns=ok)))
    assert any("below zero" in x for x in problems(spec(tolerances={"amount": "-1"}, ignored_columns=ok)))
    assert any("on a key" in x for x in problems(spec(tolerances={"id": "1"}, ignored_columns=ok)))
    assert problems(spec(tolerances={"amount": "0.01"}, ignored_columns=ok)) == []


def test_range_rules():
    ok = ("body", "tags")
    s = spec(full_refresh=False, range_column="day", ignored_columns=ok)
    assert any("has no row range" in x for x in problems(s))
    assert problems(s, rng=RowRange("2026-01-01", "2026-02-01")) == []
    assert any("holds nothing" in x for x in problems(s, rng=RowRange("2026-02-01", "2026-01-01")))
    assert any("is no date" in x for x in problems(s, rng=RowRange("yesterday", "2026-01-01")))
    assert any("not compared whole" in x for x in problems(spec(full_refresh=False, ignored_columns=ok)))


def test_bad_bounds_are_problems_not_errors():
    ok = ("body", "tags")
    number = spec(full_refresh=False, range_column="id", ignored_columns=ok)
    for lo, hi in (("NaN", "5"), ("0", "Infinity"), ("x", "5")):
        assert len(problems(number, rng=RowRange(lo, hi))) == 1
    day = spec(full_refresh=False, range_column="day", ignored_columns=ok)
    assert len(problems(day, rng=RowRange("2026-01-01T00:00:00", "2026-01-02T00:00:00+01:00"))) == 1
    zoned = spec(full_refresh=False, range_column="zoned", ignored_columns=ok)
    assert problems(zoned, rng=RowRange("2026-01-01T00:00:00", "2026-01-02T00:00:00+01:00")) == []


def test_missing_on_both_sides_is_a_typo_one_side_is_not():
    ok = ("body", "tags")
    assert any("neither side" in x for x in problems(spec(ignored_columns=ok), cand=None, base=None))
    assert problems(spec(ignored_columns=ok), cand=SCHEMA, base=None) == []
    assert problems(spec(ignored_columns=ok), cand="unavailable", base="unavailable") == []


def test_names_and_paths():
    assert any("not a plain name" in x for x in problems(spec(ignored_columns=("body", "tags")), pipeline="bad name!"))
    assert any("plain relative path" in x for x in problems(spec(candidate=Location(path="../etc"), ignored_columns=("body", "tags"))))
    assert any("plain relative path" in x for x in problems(spec(candidate=Location(path="/abs"), ignored_columns=("body", "tags"))))
    two = [spec(ignored_columns=("body", "tags")), spec(ignored_columns=("body", "tags"))]
    assert any("used twice" in x for x in config_problems("p", two, {"t": (SCHEMA, SCHEMA)}))


def test_schema_differences_sorted_and_ignoring(spark):
    a = T.StructType.fromDDL("id bigint, b string, a string, x int")
    b = T.StructType.fromDDL("id bigint, c string, x bigint")
    assert schema_differences(a, b) == [
        "a: string -> none",
        "b: string -> none",
        "c: none -> string",
        "x: int -> bigint",
    ]
    assert schema_differences(a, b, ("a", "b", "c", "x")) == []


def test_fingerprint_matches_duckdb(spark):
    rows = [(1, "a", Decimal("1.50"), dt.datetime(2026, 1, 1, 1, 2, 3, 456789), None), (2, None, None, None, "x y ")]
    ddl = "id bigint, s string, d decimal(12,2), ts timestamp_ntz, t string"
    df = spark.createDataFrame(rows, ddl)
    cols = columns_of(df.schema)
    got = {r["id"]: r["fp"] for r in df.select("id", fingerprint(cols).alias("fp")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE x (id BIGINT, s VARCHAR, d DECIMAL(12,2), ts TIMESTAMP, t VARCHAR)")
    con.executemany("INSERT INTO x VALUES (?, ?, ?, ?, ?)", rows)
    null = "'N" + "0" * 32 + "'"

    def piece(c, canon):
        return f"CASE WHEN {c} IS NULL THEN {null} ELSE 'V' || md5({canon}) END"

    expr = " || ".join([
        piece("id", "CAST(id AS VARCHAR)"), piece("s", "s"), piece("d", "CAST(d AS VARCHAR)"),
        piece("ts", "strftime(CAST(ts AS TIMESTAMP_NS), '%Y-%m-%dT%H:%M:%S.%n')"), piece("t", "t"),
    ])
    want = dict(con.execute(f"SELECT id, md5({expr}) FROM x").fetchall())
    assert got == want


def test_zoned_timestamps_render_in_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(dt.datetime(2026, 1, 1, 12, 0, 0, tzinfo=dt.timezone.utc),)], "z timestamp")
        text = df.select(canonical(ColumnInfo("z", T.TimestampType())).alias("t")).collect()[0]["t"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert text == "2026-01-01T12:00:00.000000000"


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "x", 2)], "`ID` bigint, `select` string, `Mixed Case` bigint")
    df = df.withColumnRenamed("select", "sel`ect")
    assert df.select(col("sel`ect"), col("Mixed Case")).collect()[0] == ("x", 2)
    df.select(fingerprint(columns_of(df.schema))).collect()


def test_jdbc_options_are_quoted_and_bounded():
    conn = JdbcConnection(url="jdbc:x://primary", replica_url="jdbc:x://replica", max_partitions=2)
    opts = table_reader_options(conn, "DWH", 'OR"DERS', partition_column="ID", lower_bound=0, upper_bound=100)
    assert opts["url"] == "jdbc:x://replica"
    assert opts["dbtable"] == '"DWH"."OR""DERS"'
    assert opts["numPartitions"] == "2" and opts["fetchsize"] == "10000"
    assert quote_identifier("a") == '"a"'


def test_categories_are_distinct():
    assert len({c for c in Category}) == 6
    assert Category.TIMESTAMP is not Category.DATE


def test_limb_checksum_equals_sum_of_sixty_bit_prefixes(spark):
    from pyspark.sql import functions as F

    from tablediff.functions.canonical import checksum_limbs, checksum_term, from_limbs

    df = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    fp = fingerprint(columns_of(df.schema))
    row = df.agg(
        F.sum(checksum_term(fp)).alias("text_form"),
        *[F.sum(x).alias(f"l{i}") for i, x in enumerate(checksum_limbs(fp))],
    ).select("text_form", from_limbs([F.col("l0"), F.col("l1"), F.col("l2")]).alias("limb_form")).collect()[0]
    assert row["text_form"] == row["limb_form"]


def test_jdbc_split_read_options():
    import datetime as dt

    from tablediff.sources.jdbc import bounds_options, bounds_query, split_options

    conn = JdbcConnection(url="jdbc:x://db", max_partitions=4)
    assert bounds_query("DWH", "ORDERS", "ID") == 'SELECT MIN("ID"), MAX("ID") FROM "DWH"."ORDERS"'
    b = bounds_options(conn, "DWH", "ORDERS", "ID")
    assert "query" in b and "dbtable" not in b
    opts = split_options(conn, "DWH", "ORDERS", "ID", 10, 99)
    assert (opts["partitionColumn"], opts["lowerBound"], opts["upperBound"], opts["numPartitions"]) == ('"ID"', "10", "100", "4")
    opts = split_options(conn, "DWH", "ORDERS", "ID", Decimal("-2.5"), Decimal("7.25"))
    assert (opts["lowerBound"], opts["upperBound"]) == ("-3", "8")
    opts = split_options(conn, "DWH", "ORDERS", "DAY", dt.date(2026, 1, 1), dt.date(2026, 2, 1))
    assert (opts["lowerBound"], opts["upperBound"]) == ("2026-01-01", "2026-02-01")
