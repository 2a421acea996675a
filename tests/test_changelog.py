"""State marks: every time's state, and how much of the log it reads."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerline.sources.changelog import ChangeLog
from ledgerline.sources.store import TableStore

SCHEMA = "log_id long, operation string, record_id long, v string, change_time timestamp_ntz"
START = dt.datetime(2030, 1, 1)


def plain(rows, at):
    last = {}
    for r in sorted(rows):
        if r[4] <= at:
            last[r[2]] = r
    return {k: r[3] for k, r in last.items() if r[1] != "DELETE"}


def made(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(["INSERT", "UPDATE", "DELETE"]), rng.randrange(40), f"v{i}",
             START + dt.timedelta(minutes=i) - dt.timedelta(minutes=rng.choice([0, 0, 0, 300]))) for i in range(1, n + 1)]


def state(log, at):
    return {r.record_id: r.v for r in log.as_of(at).collect()}


def test_state_at_any_time_with_late_rows(spark, tmp_root):
    log = ChangeLog(TableStore(spark, f"{tmp_root}/log"), "record_id", ["v"], every=100)
    rows = made(600, 1)
    for i in range(0, 600, 60):
        log.append(spark.createDataFrame(rows[i:i + 60], SCHEMA))
    assert len(log.segments()) == 10 and 3 <= len(log.marks()) <= 6
    times = [START - dt.timedelta(days=9), rows[50][4], dt.datetime.fromisoformat(log.marks()[1]["time"]), rows[333][4], rows[-1][4], START + dt.timedelta(days=9)]
    for at in times:
        assert state(log, at) == plain(rows, at), at
    log.compact()
    log.append(spark.createDataFrame([(1000, "UPDATE", 3, "late", START)], SCHEMA))     # older than every mark, greater id
    rows.append((1000, "UPDATE", 3, "late", START))
    again = ChangeLog(TableStore(spark, f"{tmp_root}/log"), "record_id", ["v"], every=100)
    for at in times:
        assert state(again, at) == plain(rows, at), at
    assert again.read().count() == 601


def test_only_the_last_mark_and_the_tail_are_read(spark, tmp_root):
    log = ChangeLog(TableStore(spark, f"{tmp_root}/log"), "record_id", ["v"], every=1 << 60)
    rows = [(i, "INSERT", i % 9, f"v{i}", START + dt.timedelta(minutes=i)) for i in range(100)]
    for i in range(0, 100, 10):
        log.append(spark.createDataFrame(rows[i:i + 10], SCHEMA))
        if i in (30, 60):
            log.mark()
    for minute, mark, tail in ((5, None, [0]), (39, 0, []), (45, 0, [4]), (69, 1, []), (75, 1, [7]), (99, 1, [7, 8, 9])):
        files = log.as_of(START + dt.timedelta(minutes=minute)).inputFiles()
        want = [log.segments()[i]["path"] for i in tail] + ([log.marks()[mark]["path"]] if mark is not None else [])
        assert {f.rpartition("/")[0].partition(":")[2].lstrip("/") for f in files} == {p.lstrip("/") for p in want}, minute
        assert state(log, START + dt.timedelta(minutes=minute)) == plain(rows, START + dt.timedelta(minutes=minute))


def test_marks_cost_no_more_than_the_log(spark, tmp_root):
    log = ChangeLog(TableStore(spark, f"{tmp_root}/log"), "record_id", ["v"], every=10)
    for i in range(8):                                                      # 50 new keys each: the state grows with the log
        log.append(spark.createDataFrame([(50 * i + j, "INSERT", 50 * i + j, "v", START + dt.timedelta(minutes=i)) for j in range(50)], SCHEMA))
    assert [m["before"] for m in log.marks()] == [1, 2, 4, 8]
    log.append(spark.createDataFrame([], SCHEMA))
    assert len(log.segments()) == 8 and log.as_of(START).count() == 50
    assert log.as_of(START).select(F.max("change_time")).first()[0] == START
