"""Messages are sent again at the stated times, by a client that fails by schedule."""

import hashlib

from quillspar.streaming.outbox import Outbox, Policy

SCHEDULE = {"a": [(200, None)], "b": [(503, None), (500, None), (204, None)], "c": [(429, 2.0), (200, None)], "d": ["raise"] * 3, "e": [(404, None)]}
POLICY = Policy(retries=2, base_ms=100, most_ms=150, jitter_ms=50)


def stated(key):
    """(attempt, time) of each call, reckoned apart."""
    at, out = 1000, []
    for attempt, answer in enumerate(SCHEDULE[key]):
        out.append((key, attempt, at))
        jitter = int(hashlib.md5(f"{key}:{attempt}".encode()).hexdigest()[:8], 16) % POLICY.jitter_ms
        at += int(answer[1] * 1000) if answer != "raise" and answer[1] else min(100 * 2**attempt, 150) + jitter
    return out


def test_calls_come_at_the_stated_times(spark, tmp_path):
    clock, log, schedule = tmp_path / "clock", tmp_path / "calls", SCHEDULE
    clock.write_text("1000")
    log.mkdir()

    def client(key, payload, attempt):
        name = f"{key}-{attempt}-{clock.read_text()}"
        (log / name).write_text((log / name).read_text() + "again" if (log / name).exists() else payload)
        answer = schedule[key][attempt]
        if answer == "raise":
            raise OSError("reset")
        return answer

    now = lambda: int(clock.read_text())
    box = Outbox(spark, str(tmp_path / "box"), client, POLICY, buckets=2)
    rows = spark.createDataFrame([(k, f"p{k}") for k in SCHEDULE] + [("a", "pz")], "key string, payload string")
    assert box.next_due() is None
    first = box.add(rows, 0, now())
    assert box.add(rows, 0, now()) == first and box.next_due() == 1000 and box.table("queue").count() == 5
    box.drain(now, lambda s: clock.write_text(str(now() + round(s * 1000))))
    made = sorted((k, int(a), int(t)) for k, a, t in (p.name.split("-") for p in log.iterdir()))
    assert made == sorted(x for k in SCHEDULE for x in stated(k))
    assert {p.read_text() for p in log.iterdir()} == {f"p{k}" for k in SCHEDULE}  # none was called twice
    assert all(r.at_ms == r.due_ms for t in ("sent", "dead") for r in box.table(t).collect())
    assert {(r.key, r.attempts, r.status) for r in box.table("sent").collect()} == {("a", 1, 200), ("b", 3, 204), ("c", 2, 200)}
    assert {(r.key, r.attempts, r.status, r.error, r.payload) for r in box.table("dead").collect()} == {("d", 3, None, "OSError: reset", "pd"), ("e", 1, 404, None, "pe")}
    assert box.next_due() is None and box.deliver(10**9).version == box.store.snapshot().version


def test_a_message_added_meanwhile_stays(spark, tmp_path):
    """A batch that another writer commits between the calls and their answers' commit is kept, and nothing is sent twice."""
    other = Outbox(spark, str(tmp_path / "box"), lambda k, p, a: (200, None), buckets=2)
    rows = lambda p: spark.createDataFrame([("k", p)], "key string, payload string")
    other.add(rows("old"), 0, 0)
    box = Outbox(spark, str(tmp_path / "box"), lambda k, p, a: (200, None), buckets=2)
    taken, real = [], box.store.commit

    def commit(base, parts, meta):
        if not taken:
            taken.append(other.add(rows("new"), 1, 5))
        return real(base, parts, meta)

    box.store.commit = commit
    box.deliver(0)
    assert [r.payload for r in box.table("queue").collect()] == ["new"] and box.table("sent").count() == 1
    assert box.store.snapshot().meta["batch"] == 1
