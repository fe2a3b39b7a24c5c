import time
from datetime import datetime, timedelta

from lodestone.streaming.watch import Watchers, sessions

START = datetime(2024, 1, 1)


def test_quiet_periods(spark):
    at = [0, 3, 7, 13, 30]
    rows = [("p", START + timedelta(seconds=s), f"f{s % 2}") for s in at] + [("q", START, "x")]
    got = sorted((r["project"], (r["first_ts"] - START).seconds, (r["flush_ts"] - START).seconds, r["n_events"], r["n_paths"]) for r in sessions(spark.createDataFrame(rows, "project string, ts timestamp, path string")).collect())
    assert got == [("p", 0, 12, 3, 2), ("p", 13, 18, 1, 1), ("p", 30, 35, 1, 1), ("q", 0, 5, 1, 1)]


def test_watcher_reindexes_on_new_files_and_starts_once(spark, tmp_path):
    root = tmp_path / "code"
    root.mkdir()
    (root / "a.py").write_text("x = 1\n")
    calls, watchers = [], Watchers(spark)
    assert watchers.start(str(root), lambda: calls.append(1), str(tmp_path / "state"), "1 second")
    assert not watchers.start(str(root), lambda: calls.append(1), str(tmp_path / "state"), "1 second")

    def reached(n):
        end = time.time() + 40
        while len(calls) < n and time.time() < end:
            time.sleep(0.2)
        return len(calls) >= n

    assert reached(1)
    (root / "b.py").write_text("y = 1\n")
    assert reached(2)
    n = len(calls)
    (root / "c.png").write_bytes(b"0")
    time.sleep(3)
    assert len(calls) == n
    assert watchers.stop(str(root)) and not watchers.stop(str(root))


def test_quiet_period_restarts(spark, tmp_path):
    """Files that keep coming hold the re-index back until they stop."""
    root = tmp_path / "code"
    root.mkdir()
    calls, watchers = [], Watchers(spark)
    (root / "a0.py").write_text("x = 1\n")
    assert watchers.start(str(root), lambda: calls.append(time.time()), str(tmp_path / "state"), "6 seconds")
    for k in range(1, 5):
        time.sleep(2)
        (root / f"a{k}.py").write_text("x = 1\n")
    last = time.time()
    while not calls and time.time() < last + 40:
        time.sleep(0.2)
    watchers.stop(str(root))
    assert len(calls) == 1 and calls[0] >= last + 5
