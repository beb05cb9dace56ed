"""Queries that must take their whole tables in."""

import os

import pytest

from tidemark import catalog

DIR = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_dates_reach_the_last_day(spark):
    lines, orders = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("lineitem", "orders"))
    months = {r[0] for r in lines.selectExpr("date_format(l_shipdate, 'yyyy-MM')").distinct().collect()}
    days = {r[0] for r in orders.selectExpr("cast(to_date(o_orderdate) as string)").distinct().collect()}
    assert {r["month"] for r in QUERIES["anchor_rescale"](spark, DIR).collect()} == months and max(months) > "2001"
    assert {r["day"] for r in QUERIES["stitch_scale"](spark, DIR).collect()} == days and max(days) > "2001"


def test_curves_are_fitted_to_the_whole_series(spark, monkeypatch):
    from tidemark.plans import kernels

    taken = []
    monkeypatch.setattr(kernels.S, "fits", lambda df, *a: taken.append(df))
    QUERIES["curve_fits"](spark, DIR)
    assert {r[0] for r in taken[0].select("month").distinct().collect()} == {r["month"] for r in QUERIES["attention_monthly"](spark, DIR).collect()}


def test_replicates_and_columns_are_the_surveys(spark, monkeypatch):
    from tidemark.plans import kernels

    drawn, columns = [], []
    replicated, block_null = kernels.R.replicated, kernels.R.block_null
    monkeypatch.setattr(kernels.R, "replicated", lambda spark, n, *a, **b: drawn.append(n) or replicated(spark, n, *a, **b))
    monkeypatch.setattr(kernels.R, "block_null", lambda spark, x, *a: columns.append(x.shape[1]) or block_null(spark, x, *a))
    for name in ("transition_bootstrap", "nyblom_stability", "curation_jackknife", "slice_null"):
        QUERIES[name](spark, DIR)
    assert drawn == [10_000, 2000, 100, 800] and columns == [25]
    assert [r["k"] for r in QUERIES["cluster_discreteness"](spark, DIR).orderBy("k").collect()] == [1, 2, 3, 4, 5, 6]


def test_signals_take_every_event(spark):
    events = spark.read.parquet(f"{DIR}/events.parquet")
    memes = {r[0] for r in events.select("event_type").distinct().collect()}
    assert {r["meme"] for r in QUERIES["platform_expanding"](spark, DIR).collect()} == memes
    assert sum(r["signals"] for r in QUERIES["daily_turnover_jaccard"](spark, DIR).collect()) == events.count()
    assert QUERIES["micro_burst"](spark, DIR).count() == 1


@pytest.mark.parametrize("page", [7, 500])
def test_lists_are_landed_whole(spark, monkeypatch, page):
    from tidemark.plans import landed

    monkeypatch.setattr(landed, "PAGE", page)
    events = spark.read.parquet(f"{DIR}/events.parquet")
    got = QUERIES["nested_list_source"](spark, DIR).collect()
    longest = max(r["count"] for r in events.selectExpr("to_date(ts) as day").groupBy("day").count().collect())
    assert len(got) == events.count() and max(r["rank"] for r in got) == longest > 7


@pytest.mark.parametrize("page", [2, 500])
def test_captures_are_migrated_whole(spark, monkeypatch, page):
    from tidemark.plans import landed

    monkeypatch.setattr(landed, "PAGE", page)
    one_hour = spark.range(40).selectExpr("id as event_id", "timestamp'2024-01-05 10:20:00' as ts", "id % 2 * 3 + 1 as user_id", "'view' as event_type", "1.5D as value", "'{}' as props")
    monkeypatch.setattr(landed, "table", lambda *a: one_hour)
    got = QUERIES["migrated_captures"](spark, DIR).collect()
    assert sorted((r["rank"], r["title"]) for r in got) == [(i + 1, f"view{i}") for i in range(40) if i % 11]


def test_numbers_of_a_keys_rows(spark):
    from tidemark.operators.windows import numbered

    rows = [(k, v) for k in ("a", None, "b") for v in (-9, -3, 0, 4, 5, 12, 13, 700)]
    got = numbered(spark.createDataFrame(rows, "k string, v bigint"), ["k"], "v", width=4).collect()
    assert {(r["k"], r["v"]): r["rank"] for r in got} == {(k, v): i for k in ("a", None, "b") for i, v in enumerate(sorted({v for _, v in rows}), 1)} and len(got) == len(rows)
