"""Queries over their whole tables, against their SQL and against counts of the tables."""

import datetime as dt
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folio.operators import corpus
from folio.operators import index as ix
from folio.streaming import incremental as inc

SF = "/root/testdata/sf0.001"
TABLES = ["customer", "documents", "events", "orders"]


def rows(spark, name, sf=SF):
    df = entry.queries()[name](spark, sf)
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def by_sql(name, sf=SF):
    """Rows of the registered SQL, which has no filter of its own."""
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = db.sql(entry.oracle_sql()[name])
    return sorted(map(tuple, got.select(*(f'"{c}"' for c in sorted(got.columns))).fetchall()), key=repr)


def test_next_maturities_of_all_days(spark):
    got = rows(spark, "next_maturities")
    assert got == by_sql("next_maturities")
    days = {r[0] for r in duckdb.sql(f"select distinct o_orderdate::date from read_parquet('{SF}/orders.parquet')").fetchall()}
    assert {r[1] for r in got} == days and len(got) == 4 * len(days)


def test_islands_of_all_users(spark):
    got = rows(spark, "gaps_and_islands")
    assert got == by_sql("gaps_and_islands")
    assert sum(r[4] for r in got) == duckdb.sql(f"select count(*) from (select distinct event_type, ts::date from read_parquet('{SF}/events.parquet'))").fetchall()[0][0]


def test_sessions_of_all_users(spark):
    sf = "/root/testdata/sf0.01"  # the smaller events have no user from 20 on
    got = rows(spark, "stream_sessions", sf)
    assert got == by_sql("stream_sessions", sf)
    assert sum(r[0] for r in got) == duckdb.sql(f"select count(*) from read_parquet('{sf}/events.parquet')").fetchall()[0][0]


def test_streams_leave_their_rows_in_files(spark):
    for name in ("stream_first_of_key", "stream_sliding", "stream_sessions"):
        assert entry.queries()[name](spark, SF).inputFiles()  # a table in the driver's memory has none
    got = rows(spark, "stream_first_of_key")
    assert got == by_sql("stream_first_of_key")
    assert len(got) == duckdb.sql(f"select count(*) from read_parquet('{SF}/events.parquet')").fetchall()[0][0]


def test_streams_of_several_batches_and_of_none(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    for i, part in enumerate([[(1, at(1)), (2, at(2))], [(2, at(3)), (3, at(4))], [(1, at(5)), (4, at(6))]]):
        spark.createDataFrame(part, "k int, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = lambda where: spark.readStream.schema("k int, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{where}")
    first = inc.to_shared(inc.first_of_key(stream("in/*"), "at", ["k"]))
    assert sorted(r.k for r in first.collect()) == [1, 2, 3, 4]
    runs = inc.to_shared(inc.sessions(stream("in/*"), "at", ["k"], "1 hour"), "complete")
    assert sorted((r.k, r.n) for r in runs.collect()) == [(1, 1), (1, 1), (2, 2), (3, 1), (4, 1)]
    (tmp_path / "none").mkdir()
    empty = inc.to_shared(inc.first_of_key(stream("none"), "at", ["k"]))
    assert empty.collect() == [] and empty.columns == ["k", "at"]


def test_robustness_without_each_outlet(spark):
    sf = "/root/testdata/sf0.01"
    names = sorted(["left_out", "window", "median_n", "n", "r", "mean_diff", "mean_abs_diff"])
    key = lambda r: (r[names.index("left_out")], r[names.index("window")])
    want = {key(r): r for r in by_sql("robustness_table", sf)}
    got = {key(r): r for r in rows(spark, "robustness_table", sf)}
    assert {k: pytest.approx(r, abs=2e-6) for k, r in got.items()} == want
    assert len(want) == 50


@pytest.mark.parametrize("back", [1, 3])
def test_levels_without_an_outlet_are_those_of_the_others(spark, back):
    # replicas over outlets, a period of one outlet alone, a last one too, a null outlet, a null kind, no signal
    days = [dt.date(2020, 1, 5), dt.date(2020, 2, 7), dt.date(2020, 2, 8), dt.date(2020, 4, 1)]
    rows = [(i, days[i * 7 % 3], [1, 2, 3, None][i % 4], ["a", "b", None][i % 3], i % 5, i % 5 + 1 if i % 9 else None, not i % 9) for i in range(60)]
    rows += [(100, days[3], 2, "a", 1, 5, False), (101, dt.date(2020, 6, 1), 3, "a", 1, 2, False)]
    items = spark.createDataFrame(rows, "item_id int, day date, outlet int, kind string, wire int, d1 int, no_signal boolean")
    got = {(r.left_out, r.period): (r.level, r.n_items) for r in ix.levels_without(items, back).collect()}
    want = {(x, r.period): (r.level, r.n_items) for x in (1, 2, 3) for r in ix.periodic_index(items.where(~F.col("outlet").eqNullSafe(F.lit(x))), back).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert ix.levels_without(items.limit(0), back).collect() == []


def test_masks_of_all_languages(spark, tmp_path):
    texts = [(1, "fr", "Le 5 mai 2020, hausse de 3,5 % à Paris."), (2, "en", "Up 4 in London."), (3, None, "In 1999"), (4, "de", None)]
    spark.createDataFrame(texts, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    masked = {1: "Le [NUM] mai [DATA], hausse de [NUM] à [NOME].", 2: "Up [NUM] in [NOME].", 3: "In [DATA]", 4: ""}
    got = {r.doc_id: r.h for r in entry.queries()["mask_level_5"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(m.encode()).hexdigest() for i, m in masked.items()}


def test_export_ids_of_all_customers(spark):
    got = rows(spark, "export_ids")
    assert got == by_sql("export_ids")
    assert sorted(int(r[1][5:]) for r in got) == list(range(duckdb.sql(f"select count(*) from read_parquet('{SF}/customer.parquet')").fetchall()[0][0]))


def test_export_numbers_over_ranges(spark):
    values = [(f"n{i * 37 % 50}" if i % 11 else None, i) for i in range(200)]
    df = spark.createDataFrame(values, "name string, k int")
    order = sorted(values, key=lambda v: (v[0] is not None, v[0] or "", v[1]))
    got = {r.k: r.id for r in corpus.with_export_id(df, F.lit("segment"), ["name", "k"], width=2).collect()}
    assert got == {k: f"segm-{i:02d}" for i, (_, k) in enumerate(order)}
    assert corpus.with_export_id(df.limit(0), F.lit("s"), ["name", "k"]).collect() == []


def test_around_every_day(spark):
    sf = "/root/testdata/sf0.01"
    assert rows(spark, "asof_around", sf) == by_sql("asof_around", sf)
