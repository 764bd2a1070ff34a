"""Streams against small models in plain Python: late rows, ties, nulls, restarts, and what a handle tells."""

import random
import socket
import threading
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import windows

ROW = "ts long, user string, amount long"


def made(seed, n=60):
    """Rows with equal times, null users and null amounts, in no order of time."""
    r = random.Random(seed)
    return [(r.choice([r.randrange(20_000), 5_000]), r.choice(["ann", "bob", "cy", None]), r.choice([r.randint(-9, 40), None])) for _ in range(n)]


def queue(spark, *parts):
    q = windows.Queue(spark, ROW)
    for p in parts:
        q.put(p)
    return q


def total(rows):
    held = [x for x in rows if x is not None]
    return sum(held) if held else None


def test_tumbling_windows(spark):
    rows = made(1)
    df = windows.event_time(queue(spark, rows[:20], rows[20:]).stream(), "ts", "1 day")
    out = windows.windowed(df, ["user"], [F.count("*").alias("n"), F.sum("amount").alias("total")], "3 seconds")
    want = defaultdict(list)
    for t, u, a in rows:
        want[t // 3000 * 3000, u].append(a)
    assert {tuple(r) for r in windows.drained(out, "complete").collect()} == {(*k, len(v), total(v)) for k, v in want.items()}


def test_rows_behind_the_mark_are_dropped(spark):
    parts = [[(40_000, "ann", 1)], [(39_500, "bob", 2)], [(100, "ann", 7), (41_000, "ann", 3), (35_500, "cy", 5)]]
    df = windows.event_time(queue(spark, *parts).stream(), "ts", "2 seconds")
    out = windows.drained(windows.windowed(df, ["user"], [F.sum("amount").alias("total")], "1 second"), "update", ["window_start", "user"])
    assert {tuple(r) for r in out.collect()} == {(40_000, "ann", 1), (39_000, "bob", 2), (41_000, "ann", 3)}


@pytest.mark.parametrize(("gap", "unit"), [(700, "millis"), (1500, "micros")])
def test_sessions(spark, gap, unit):
    rows = [x for x in made(2) if x[1]]
    df = windows.event_time(queue(spark, rows[:30], rows[30:]).stream(), "ts", "1 day")
    out = windows.sessions(df, ["user"], [F.count("*").alias("n")], f"{gap} milliseconds", unit=unit)
    want, scale = set(), 1000 if unit == "micros" else 1
    for user in {u for _, u, _ in rows}:
        own = sorted(t for t, u, _ in rows if u == user)
        held = [own[0]]
        for t in own[1:]:
            if t - held[-1] > gap:
                want.add((held[0] * scale, held[-1] * scale, user, len(held)))
                held = []
            held.append(t)
        want.add((held[0] * scale, held[-1] * scale, user, len(held)))
    assert {tuple(r) for r in windows.drained(out, "complete").collect()} == want


def test_first_of_each_key(spark):
    rows = [x for x in made(3) if x[1]]
    df = windows.event_time(queue(spark, rows[:25], rows[25:]).stream(), "ts", "1 day")
    out = windows.drained(windows.dedup(df, ["user", "amount"]).select("user", "amount"))
    assert Counter(map(tuple, out.collect())) == Counter({(u, a) for _, u, a in rows})


def test_state_goes_on_over_batches_and_forgets(spark):
    parts = [[(0, "ann", 4), (1, "bob", 10), (1, "cy", 1)], [(2, "ann", 3), (3, "bob", 1)]]
    out = windows.update_state(queue(spark, *parts).stream(), "user", "amount", lambda values, old: None if (values == 10).any() else old + int(values.sum()), 0, "long")
    assert {tuple(r) for r in windows.drained(out, "update", ["user"]).collect()} == {("ann", 7), ("bob", 1), ("cy", 1)}


def test_sums_of_windows_from_panes(spark):
    r = random.Random(4)
    rows = [(r.randrange(0, 40) * 500, r.choice("ab"), r.randint(-5, 5)) for _ in range(50)]
    panes = defaultdict(int)
    for t, u, a in rows:
        panes[t // 1000 * 1000, u] += a
    done = spark.createDataFrame([(*k, v) for k, v in panes.items()], "window_start long, user string, amount long")
    want = defaultdict(int)
    for (t, u), a in panes.items():
        for k in range(3):
            want[t - 1000 * k, u] += a
    assert {tuple(x) for x in windows.reduce_by_window(done, ["user"], "amount", 3000, 1000).collect()} == {(*k, v) for k, v in want.items()}
    with pytest.raises(ValueError):
        windows.reduce_by_window(done, ["user"], "amount", 2500, 1000)


def test_a_second_run_reads_what_is_new(spark, tmp_path):
    q = queue(spark, [(1, "ann", 2)])
    run = lambda: windows.drained(q.stream().select("user", "amount"), at=str(tmp_path))
    assert run().count() == 1
    q.put([(2, "bob", 3)]).put([(3, None, None)])
    assert run().count() == 3 == run().count()


def test_streams_start_once_and_errors_go_up(spark, tmp_path):
    q = queue(spark, [(1, "ann", 2)])

    def fails(batch, epoch):
        raise RuntimeError("no room")

    made_ = windows.Streams(spark, str(tmp_path)).add("one", q.stream, fails).start()
    with pytest.raises(RuntimeError):
        made_.add("two", q.stream, fails)
    with pytest.raises(Exception, match="no room"):
        made_.wait()
    assert windows.status(made_.running["one"])["error"]
    made_.stop()


def test_lines_of_a_socket(spark, tmp_path):
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        held, _ = server.accept()
        held.sendall(b"one\ntwo\nthree\n")
        held.settimeout(30)
        try:
            held.recv(1)
        except OSError:
            pass

    threading.Thread(target=serve, daemon=True).start()
    seen = []
    df = windows.socket_source(spark, "127.0.0.1", server.getsockname()[1])
    q = windows.per_batch(df, lambda batch, epoch: seen.extend(r[0] for r in batch.collect()), str(tmp_path), once=False)
    for _ in range(300):
        if len(seen) >= 3:
            break
        q.awaitTermination(0.1)
    q.stop()
    server.close()
    assert seen == ["one", "two", "three"]


def test_console(spark):
    q = windows.to_console(queue(spark, [(1, "ann", 2)]).stream())
    q.processAllAvailable()
    said = windows.status(q)
    q.stop()
    assert said["active"] and said["rows"] == 1 and not q.isActive and q.exception() is None


def test_json_payloads(spark):
    df = spark.createDataFrame([(b'{"x": 3}',), (b"broken",), (None,)], "value binary")
    assert sorted((r[0] for r in windows.decoded(df, "x int").collect()), key=str) == [3, None, None]
