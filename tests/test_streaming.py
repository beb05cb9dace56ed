"""The store's commits and retention, and the candidates' states, over failures and restarts."""

from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.streaming import candidates as C, jobs, store

DAY = datetime(2024, 1, 1)
ROW = "id bigint, ts timestamp"


def landed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema, files=1):
    return jobs.source(spark, path, schema, files)


def test_a_batch_that_fails_between_write_and_commit_is_there_once(spark, tmp_path, monkeypatch):
    landed(spark, f"{tmp_path}/in", [(i, DAY + timedelta(hours=5 * i)) for i in range(20)], ROW)
    landed(spark, f"{tmp_path}/in", [(i, DAY + timedelta(hours=5 * i)) for i in range(20, 30)], ROW)
    commit, tries = store.commit, []

    def failing(*a):
        tries.append(a)
        if len(tries) == 2:
            raise OSError("the machine stops")
        commit(*a)

    monkeypatch.setattr(store, "commit", failing)
    with pytest.raises(StreamingQueryException):
        jobs.capture(stream(spark, f"{tmp_path}/in", ROW), f"{tmp_path}/out", f"{tmp_path}/at")
    # the second batch is written but isn't committed: nobody sees it
    assert store.commits(spark, f"{tmp_path}/out").count() == 1 and len(store._listed(spark, f"{tmp_path}/out/data/stream=*/batch=*")) == 2
    assert store.rows(spark, f"{tmp_path}/out", ROW).count() in (10, 20)
    jobs.capture(stream(spark, f"{tmp_path}/in", ROW), f"{tmp_path}/out", f"{tmp_path}/at")
    assert sorted(r["id"] for r in store.rows(spark, f"{tmp_path}/out", ROW).collect()) == list(range(30))
    assert {r["rows"] for r in store.commits(spark, f"{tmp_path}/out").collect()} == {10, 20}


def test_a_batch_that_fails_after_its_commit_is_there_once(spark, tmp_path):
    df = spark.createDataFrame([(1, DAY), (2, DAY)], ROW)
    for _ in range(3):
        store.append(df, 7, f"{tmp_path}/out", "s")
    store.append(df.limit(0), 8, f"{tmp_path}/out", "s")
    store.append(df.limit(1), 7, f"{tmp_path}/out", "other")
    assert store.rows(spark, f"{tmp_path}/out", ROW).groupBy("stream").count().orderBy("stream").collect() == [("other", 1), ("s", 2)]
    assert store.rows(spark, f"{tmp_path}/nothing", ROW).count() == 0 and store.expire(spark, f"{tmp_path}/nothing", "2024-01-01", 3) == []


def test_retention_deletes_days_and_what_no_commit_names(spark, tmp_path, monkeypatch):
    at = f"{tmp_path}/out"
    df = spark.createDataFrame([(i, DAY + timedelta(days=i)) for i in range(6)], ROW)
    store.append(df, 0, at, "s")
    store.written(df, 1, at, "s")  # never committed
    store.append(df, 2, at, "s")
    store.written(df, 3, at, "s")  # on its way
    assert store.expire(spark, at, "2024-01-06", 0) and not store.expire(spark, at, "2024-01-06", 0)
    assert store.rows(spark, at, ROW).count() == 12
    # a failure after the record, before the deletion: the days are gone for readers, and go next time
    real = store._fs
    with monkeypatch.context() as m:
        m.setattr(store, "_listed", lambda *a: (_ for _ in ()).throw(OSError("the machine stops")) if "dt=*" in a[1] else real_listed(*a))
        real_listed = lambda spark, pattern: [s.getPath().toString() for s in real(spark, pattern)[0].globStatus(real(spark, pattern)[1]) or ()]
        with pytest.raises(OSError):
            store.expire(spark, at, "2024-01-06", 2)
    assert sorted({str(r["dt"]) for r in store.rows(spark, at, ROW).collect()}) == ["2024-01-04", "2024-01-05", "2024-01-06"]
    gone = store.expire(spark, at, "2024-01-06", 2)
    assert sorted({g.rsplit("dt=", 1)[1] for g in gone}) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert store.rows(spark, at, ROW).count() == 6 and store.expire(spark, at, "2024-01-06", 2) == []
    assert store.expire(spark, at, "2024-01-02", 2) == [] and store.rows(spark, at, ROW).count() == 6  # days do not come back


TITLES = "title string, scrape timestamp"


def hours(title, *at):
    return [(title, DAY + timedelta(hours=h)) for h in at]


EARLY = [*hours("steady topic", 0, 30), *hours("slow topic", 0, 60), *hours("noise topic", 3), *hours("no answer topic", 1, 2), *hours("late no answer", 10), *hours("abc", 1), *hours("meme 12", 5), (None, DAY)]
LATE = [*hours("steady topic", 100, 110), *hours("slow topic", 100), *hours("noise topic", 100, 101), *hours("late no answer", 70, 111), *hours("fresh topic", 111, 112), *hours("gone no answer", 100, 101)]


def run(spark, base, parts):
    for k, rows in enumerate(parts):
        landed(spark, f"{base}/in", rows, TITLES)
        service = lambda title: None if "no answer" in title else len(title) / 10
        t = C.transitions(stream(spark, f"{base}/in", TITLES), service, ["known"], ["noise"])
        jobs.capture(t, f"{base}/out", f"{base}/at", "candidates", "since", "update")
    changes = store.rows(spark, f"{base}/out", C.TRANSITION)
    return changes, {r["title"]: (r["status"], r["since"], r["score"]) for r in C.standing(changes).collect()}


def test_two_runs_with_a_restart_between_them_give_what_one_gives(spark, tmp_path):
    at = lambda h: DAY + timedelta(hours=h)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    want = {
        "steady topic": ("scored", at(30), 1.2), "slow topic": ("scored", at(100), 1.0), "noise topic": ("rejected", at(3), None), "no answer topic": ("expired", at(50), None),
        "late no answer": ("candidate", at(111), None), "abc": ("rejected", at(1), None), "meme 12": ("rejected", at(5), None), "fresh topic": ("scored", at(112), 1.1), "gone no answer": ("candidate", at(101), None),
    }
    _, one = run(spark, tmp_path / "one", [EARLY + LATE])
    changes, two = run(spark, tmp_path / "two", [EARLY, LATE])
    assert one == two == want
    # a scored or rejected title never returns, and each change is there once
    per = {(r["title"], r["status"]): r["count"] for r in changes.groupBy("title", "status").count().collect()}
    assert per["steady topic", "scored"] == per["noise topic", "rejected"] == 1 and changes.filter("title = 'steady topic'").count() == 2
    last = [r["n"] for r in changes.filter("title = 'no answer topic'").orderBy("n").collect()]
    assert last == [1, 2]
    _, three = run(spark, tmp_path / "two", [hours("steady topic", 113, 114) + hours("noise topic", 113)])
    assert three["steady topic"] == want["steady topic"] and three["noise topic"] == want["noise topic"]


def test_acceptable_titles():
    ok = lambda t: C.acceptable(t, ["known"], ["noise"])
    assert ok("four") and ok("x" * 30) and ok("ten chars 1") and not ok("abc") and not ok("x" * 31) and not ok("short 1") and not ok("a known one") and not ok("the noise")
