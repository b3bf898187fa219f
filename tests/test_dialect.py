"""The aggregate check as SQL: what the rendered text gives equals what Spark gives, on the driver's tables."""

import datetime as dt
from decimal import Decimal

import duckdb
import pytest
from conftest import SF01
from pyspark.sql import types as T

from tablediff.functions.types import columns_of
from tablediff.operators import aggregate as agg
from tablediff.operators import digest
from tablediff.operators.columns import column_sets
from tablediff.operators.scope import apply_row_range
from tablediff.plans.fixtures import lineitem_pair, orders_pair
from tablediff.sources import jdbc
from tablediff.sources.dialect import DIALECTS, Dialect, dialect_named, differing_answers, typed_answer, values_of_answers
from tablediff.spec import RowRange

DUCK = dialect_named("duckdb")


def answered(spark, con, relation, cs, side, where=None, classes=digest.CLASSES):
    found = con.sql(DUCK.aggregate_query(relation, cs, where, classes))
    rows = [tuple(None if v is None else str(v) for v in r) for r in found.fetchall()]
    answer = spark.createDataFrame(rows, T.StructType([T.StructField(c, T.StringType()) for c in found.columns]))
    return typed_answer(answer, cs, side)


def close(got, want, cs):
    assert got.schema.simpleString() == want.schema.simpleString()
    a, b = (sorted((r.asDict() for r in df.collect()), key=lambda r: r["side"]) for df in (got, want))
    floats = [agg.sum_name(c) for c in cs.sum_columns if c.floating]
    for x, y in zip(a, b, strict=True):
        for f in floats:
            assert x.pop(f) == pytest.approx(y.pop(f), rel=1e-12)
        assert x == y


@pytest.fixture(scope="module")
def con(tmp_path_factory):
    c = duckdb.connect()
    yield c
    c.close()


def registered(spark, con, df, name, tmp_path):
    path = str(tmp_path / name)
    df.write.parquet(path)
    con.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    return spark.read.parquet(path)


@pytest.mark.parametrize("pair", ["orders", "orders with a tolerance", "lineitem"])
def test_answers_equal_sparks_values(spark, con, tmp_path, pair):
    make = lineitem_pair if pair == "lineitem" else orders_pair
    cand, base = (registered(spark, con, df, n, tmp_path) for df, n in zip(make(spark, SF01), ("cand", "base")))
    keys = () if pair == "lineitem" else ("o_orderkey",)
    cs = column_sets(cand.schema, keys, (), {"o_totalprice": "0.01"} if "tolerance" in pair else {})
    rows = answered(spark, con, "cand", cs, "candidate").unionByName(answered(spark, con, "base", cs, "baseline"))
    close(values_of_answers(rows, cs), agg.aggregate_values(cand, base, cs), cs)
    # The same classes differ, too.
    own = digest.class_rows(cand, base, cs)
    local = spark.createDataFrame(own.collect(), own.schema)
    want = sorted(r["class"] for r in digest.differing_classes(local).collect())
    assert sorted(r["class"] for r in differing_answers(rows).collect()) == want and want


def test_a_row_range_reaches_the_query(spark, con, tmp_path):
    base = registered(spark, con, spark.read.parquet(f"{SF01}/orders.parquet"), "ranged", tmp_path)
    cs = column_sets(base.schema, ("o_orderkey",))
    by_name = {c.name: c for c in columns_of(base.schema)}
    for name, rng in (("o_orderdate", RowRange("1995-01-01", "1996-01-01T12:00:00")), ("o_orderkey", RowRange("100.5", "2000"))):
        where = DUCK.row_range(by_name[name], rng)
        part = apply_row_range(base, name, rng)
        rows = [answered(spark, con, "ranged", cs, s, where) for s in ("candidate", "baseline")]
        close(values_of_answers(rows[0].unionByName(rows[1]), cs), agg.aggregate_values(part, part, cs), cs)


def test_nothing_answered_is_a_side_without_rows(spark):
    cs = column_sets(T.StructType.fromDDL("id long, v decimal(10,2)"), ("id",), (), {"v": "1"})
    none = spark.createDataFrame([], T.StructType([T.StructField("class", T.IntegerType()), *agg.aggregate_values_schema(cs).fields[1:]]))
    rows = typed_answer(none, cs, "candidate")
    got = {r["side"]: r for r in values_of_answers(rows, cs).collect()}
    assert got["candidate"]["row_count"] == got["baseline"]["row_count"] == 0 and got["baseline"]["checksum"] is None
    assert differing_answers(rows).count() == 0


def test_every_dialect_renders_every_type():
    cs = column_sets(
        T.StructType.fromDDL("`ID` long, `A\"B` decimal(10,2), f double, s string, d date, t timestamp_ntz, z timestamp"), ("ID",), (), {"f": "1"}
    )
    for d in DIALECTS.values():
        text = d.aggregate_query('"DWH"."T"', cs, "1 = 1", 16)
        assert text.count("(") == text.count(")") and '"A""B"' in text and "GROUP BY" in text
        assert "MIN(" in text and "WHERE 1 = 1" in text
    oracle = dialect_named("oracle").aggregate_query("T", cs)
    assert "STANDARD_HASH" in oracle and "SYS_EXTRACT_UTC" in oracle and "GROUP BY" not in oracle
    with pytest.raises(ValueError, match="no SQL dialect"):
        dialect_named("basic")
    with pytest.raises(ValueError, match="takes no part"):
        DUCK.canonical(columns_of(T.StructType.fromDDL("b binary"))[0])
    assert Dialect().text_literal("it's") == "'it''s'"


# --- splits ----------------------------------------------------------------------------------------------------------


def test_splits_are_equally_full_inside_the_range_and_hold_each_row_once(con):
    con.sql(
        "CREATE OR REPLACE TABLE skewed AS SELECT CASE WHEN i < 9000 THEN i ELSE i * 1000000 END AS k, i AS day FROM range(10000) r(i) "
        "UNION ALL SELECT NULL, i FROM range(50) r(i) UNION ALL SELECT 5, i FROM range(3000) r(i)"
    )
    for where in (None, '"day" >= 2000 AND "day" < 9900'):
        starts = [r[0] for r in con.sql(DUCK.split_query("skewed", "k", 4, where)).fetchall()]
        conditions = jdbc.split_predicates(DUCK, "k", starts)
        inside = f" AND {where}" if where else ""
        sizes = [con.sql(f"SELECT count(*) FROM skewed WHERE {c}{inside}").fetchall()[0][0] for c in conditions]
        total = con.sql("SELECT count(*) FROM skewed" + (f" WHERE {where}" if where else "")).fetchall()[0][0]
        assert sum(sizes) == total and len(sizes) == 4
        assert max(sizes) < 0.5 * total
        nulls = [con.sql(f"SELECT count(*) FROM skewed WHERE k IS NULL AND {c}").fetchall()[0][0] for c in conditions]
        assert nulls == [50, 0, 0, 0]


def test_split_conditions_of_all_kinds_of_bounds():
    assert jdbc.split_predicates(DUCK, "k", []) == ["1 = 1"]
    assert jdbc.split_predicates(DUCK, "k", [7, 7, None]) == ["1 = 1"]
    got = jdbc.split_predicates(DUCK, "k", [Decimal("1.50"), Decimal("2"), Decimal("2")])
    assert got == ['("k" < 2 OR "k" IS NULL)', '("k" >= 2)']
    day = jdbc.split_predicates(DUCK, "d", [dt.date(2026, 1, 1), dt.date(2026, 2, 1), dt.date(2026, 3, 1)])
    assert day[1] == "(\"d\" >= DATE '2026-02-01' AND \"d\" < DATE '2026-03-01')"
    at = jdbc.split_predicates(DUCK, "t", [dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1, 3)])
    assert at[0] == "(\"t\" < TIMESTAMP '2026-02-01 03:00:00' OR \"t\" IS NULL)"
    assert jdbc.split_predicates(DUCK, "s", ["a", "it's"])[1] == "(\"s\" >= 'it''s')"


# --- exact numbers ---------------------------------------------------------------------------------------------------


def test_numbers_without_a_precision_are_read_as_text():
    columns = [("ID", 2, 10, 0), ("FREE", 2, 0, -127), ("WIDE", 3, 40, 2), ("AMOUNT", 3, 38, 20), ("NAME", 12, 50, None), ("odd`", 2, None, None)]
    assert jdbc.exact_types(columns) == "`ID` DECIMAL(10, 0), `FREE` STRING, `WIDE` STRING, `AMOUNT` DECIMAL(38, 20), `odd``` STRING"
    assert jdbc.exact_types(columns, frozenset({"FREE", "odd`", "ID"})) == "`WIDE` STRING, `AMOUNT` DECIMAL(38, 20)"
    assert jdbc.exact_types([("NAME", 12, 50, None)]) == ""


def test_texts_of_exact_numbers_differ_beyond_ten_decimals(spark):
    """What such a column is then compared by: its text, so a difference in the eleventh decimal is one."""
    one = spark.createDataFrame([(1, "0.12345678901")], "id long, free string")
    other = spark.createDataFrame([(1, "0.12345678902")], "id long, free string")
    cs = column_sets(one.schema, ("id",))
    a, b = agg.aggregate_values(one, other, cs).collect()
    assert a["checksum"] != b["checksum"]


def test_options_of_queries_and_steps():
    conn = jdbc.JdbcConnection(url="jdbc:x://db", dialect="oracle", equal_steps=True)
    assert jdbc.query_options(conn, "SELECT 1")["query"] == "SELECT 1" and "dbtable" not in jdbc.query_options(conn, "SELECT 1")
    assert jdbc.bounds_query("S", "T", "K", '"D" >= 1') == 'SELECT MIN("K"), MAX("K") FROM "S"."T" WHERE "D" >= 1'
