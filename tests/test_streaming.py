"""Streams that stop, go on and bring a day in several batches."""

import pytest

from millrace.streaming import live

SCHEMA = "day string, delivery int, id int, value int"


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def bag(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_day_in_several_batches_and_a_later_delivery(spark, tmp_path):
    folder, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    first = [("a", 1, k, k) for k in range(4)] + [("b", 1, 9, 9)]
    for k in range(5):
        land(spark, folder, [first[k]])
    run = lambda: live.replace_touched(live.read_folder(spark, folder, SCHEMA, files=1), "day", "delivery", sink)
    assert bag(run()) == sorted(first)
    for row in (("a", 2, 0, 50), ("a", 2, 7, 70)):
        land(spark, folder, [row])
    assert bag(run()) == [("a", 2, 0, 50), ("a", 2, 7, 70), ("b", 1, 9, 9)]
    land(spark, folder, [("a", 2, 8, 80)])  # more of the same delivery, after a restart
    assert bag(run()) == [("a", 2, 0, 50), ("a", 2, 7, 70), ("a", 2, 8, 80), ("b", 1, 9, 9)]


def test_latest_state_goes_on_after_a_restart(spark, tmp_path):
    folder, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    run = lambda: live.keep_latest(live.read_folder(spark, folder, SCHEMA, files=1), ["id"], ["value"], sink, compact=3)
    expected = {}
    for k in range(9):
        row = ("d", k, k % 4, (k * 5) % 7)
        land(spark, folder, [row])
        if row[3] > expected.get(row[2], row)[3] or row[2] not in expected:
            expected[row[2]] = row
        if k in (2, 8):
            assert bag(run()) == sorted(expected.values())
    assert bag(run()) == sorted(expected.values())  # nothing new
    assert len(live.Store(spark, sink).state()[1][live.LOG]["entries"]) <= 4


def newest(rows):
    return sorted({i: max((r for r in rows if r[2] == i), key=lambda r: r[3]) for i in {r[2] for r in rows}}.values())


def test_two_streams_fill_one_state(spark, tmp_path):
    sink, rows = f"{tmp_path}/out", [[("a", 1, k, 1) for k in range(3)], [("b", 1, 1, 5), ("b", 1, 9, 1)]]
    run = lambda n: live.keep_latest(live.read_folder(spark, f"{tmp_path}/in{n}", SCHEMA, files=1), ["id"], ["value"], sink, f"{tmp_path}/check{n}", compact=2)
    for n in (0, 1):
        land(spark, f"{tmp_path}/in{n}", rows[n])
        got = bag(run(n))
    assert got == newest(rows[0] + rows[1])
    for n in (0, 1, 0):  # both start at their next batch, over the merges of each other
        land(spark, f"{tmp_path}/in{n}", more := [("c", 2, n, 7 + len(rows[n])), ("c", 2, 20 + n, 1)])
        rows[n] += more
        assert bag(run(n)) == newest(rows[0] + rows[1])


def test_a_lost_checkpoint_loses_no_rows(spark, tmp_path):
    folder, sink, check = f"{tmp_path}/in", f"{tmp_path}/out", tmp_path / "check"
    run = lambda: live.keep_latest(live.read_folder(spark, folder, SCHEMA, files=1), ["id"], ["value"], sink, str(check), compact=3)
    rows = [("a", 1, 1, 1), ("a", 1, 2, 2)]
    for r in rows:
        land(spark, folder, [r])
    first = run()
    assert bag(first) == rows
    check.rename(tmp_path / "gone")
    for r in (("b", 2, 1, 9), ("b", 2, 3, 3)):
        rows.append(r)
        land(spark, folder, [r])
    assert bag(run()) == newest(rows)
    assert bag(first) == [("a", 1, 1, 1), ("a", 1, 2, 2)]  # a frame reads what it was made from, over merges


def test_a_stop_in_the_middle_of_a_merge(spark, tmp_path, monkeypatch):
    from millrace.sources import commits

    folder, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    run = lambda: live.keep_latest(live.read_folder(spark, folder, SCHEMA, files=1), ["id"], ["value"], sink, compact=2)
    rows = [("a", k, k % 3, k) for k in range(5)]
    for r in rows:
        land(spark, folder, [r])
    put, calls = commits.put_file, []

    def fail(*args, **more):
        calls.append(1)
        if len(calls) == 4:  # three batches, then the merge: its rows are written, its commit is not
            raise OSError("stopped")
        return put(*args, **more)

    monkeypatch.setattr(commits, "put_file", fail)
    with pytest.raises(Exception, match="stopped"):
        run()
    monkeypatch.undo()
    assert bag(live.latest_state(spark, sink, live.read_folder(spark, folder, SCHEMA).schema, ["id"], ["value"])) == newest(rows[:3])
    assert bag(run()) == newest(rows)  # the third batch runs again and is there already


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert live.keep_latest(live.read_folder(spark, f"{tmp_path}/in", SCHEMA), ["id"], ["value"], f"{tmp_path}/a").count() == 0
    assert live.replace_touched(live.read_folder(spark, f"{tmp_path}/in", SCHEMA), "day", "delivery", f"{tmp_path}/b").count() == 0
