"""Streams that are broken off and go on; the schedule of cards."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textmill.operators import embedding as M
from textmill.operators import scheduling as S
from textmill.streaming import logs, watches

EVENTS = "user long, ts timestamp, n long, state string"


def put(spark, path, name, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{path}/{name}")


def watch(spark, tmp_path, out, checkpoint):
    with logs.settings(spark, watches.STATE_STORE):
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        told = watches.watched(stream, "user", "ts", "n", F.col("state"), F.col("state") == "done", "10 seconds")
        logs.to_table(told, str(tmp_path / out), str(tmp_path / checkpoint))
    return sorted((r.key, r.at // 1000, r.event, r.state) for r in spark.read.schema(watches.TOLD).parquet(str(tmp_path / out)).collect())


def test_watch_survives_restarts(spark, tmp_path):
    start = datetime(2024, 1, 1)
    t0 = 1704067200
    event = lambda user, s, n, state: (user, start + timedelta(seconds=s), n, state)
    put(spark, tmp_path / "in", "a", [event(1, 0, 1, "queued"), event(1, 5, 2, "queued"), event(2, 0, 1, "run"), event(1, 20, 4, "run"), event(1, 20, 3, "queued")])
    put(spark, tmp_path / "in", "b", [event(2, 62, 3, "done"), event(2, 63, 4, "late"), event(1, 40, 5, "queued")])
    first = watch(spark, tmp_path, "out", "state")
    put(spark, tmp_path / "in", "c", [event(3, 110, 1, "x"), event(2, 100, 9, "again")])
    two = watch(spark, tmp_path, "out", "state")
    expected = [(1, t0, "progress", "queued"), (1, t0 + 15, "ping", None), (1, t0 + 20, "progress", "run"), (1, t0 + 35, "ping", None), (1, t0 + 40, "progress", "queued")]
    expected += [(1, t0 + s, "ping", None) for s in (55, 70, 85, 100)] + [(2, t0, "progress", "run"), *((2, t0 + s, "ping", None) for s in (15, 30, 45, 60)), (2, t0 + 62, "progress", "done"), (2, t0 + 62, "end", "done")]
    assert set(first) < set(two) and two == sorted(expected, key=lambda r: r[:3])
    assert watch(spark, tmp_path, "whole", "other") == two


class Store:
    """What a watch asks of its store, counted."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.upto


def test_watch_asks_its_store_a_few_times():
    """However many rows of a key wait, it has one timer for them and one value."""
    store, watcher = Store(), watches.Watch(1000)
    watcher.init(store)
    rows = [(7, None, at, at, "ab"[at // 50 % 2], at == 900) for at in range(999, -1, -1)]
    watcher.handleInputRows((7,), iter(rows), store)
    assert store.calls <= 3 and store.timers == [0]
    store.calls, store.upto, told = 0, 425, []
    told += watcher.handleExpiredTimer((7,), store, None)
    assert store.calls <= 3 and store.timers == [0, 426]
    store.upto = 5000
    told += watcher.handleExpiredTimer((7,), store, None)
    assert [(r.at, r.event, r.state) for r in told] == [*((at, "progress", "ab"[at // 50 % 2]) for at in range(0, 901, 50)), (900, "end", "a")] and len(store.timers) == 2
    watcher.handleInputRows((7,), iter(rows), store)
    assert watcher.handleExpiredTimer((7,), store, None).__length_hint__() == 0 and len(store.timers) == 2 and store.value[2:] == (True, "[]")


def test_embedding_goes_on(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    texts = [f"text {i} " + "x" * (200 if i % 7 == 0 else 1) for i in range(60)] + ["text 3 x"] * 5
    for k in range(4):
        rows = [(f"h{t}", t) for t in texts[k::4]]
        spark.createDataFrame(rows, "text_sha256 string, text string").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))

    def embedder(breaks):
        def embed(batch, truncate):
            if not truncate and any(len(t) > 100 for t in batch):
                raise M.Overflow
            if breaks and os.path.exists(breaks) and "text 2 x" in batch:
                raise RuntimeError("broken")
            with open(f"{calls}/{os.getpid()}", "a") as f:
                f.write("".join(json.dumps([t, truncate]) + "\n" for t in batch))
            return [[float(len(t)), 1.0] for t in batch]

        return embed

    def run(breaks=None):
        stream = spark.readStream.schema("text_sha256 string, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        told = []
        M.embed_stream(stream, str(tmp_path / "store"), str(tmp_path / "checkpoint"), "m", embedder(breaks), 2, lambda n, new: told.append((n, new)), 8)
        return told

    flag = tmp_path / "flag"
    flag.touch()
    with pytest.raises(PySparkException):
        run(str(flag))
    committed = {r.text_sha256 for r in M.stored(spark, str(tmp_path / "store")).collect()}
    flag.unlink()
    before = [json.loads(x) for f in calls.iterdir() for x in f.read_text().splitlines()]
    told = run()
    after = [json.loads(x) for f in calls.iterdir() for x in f.read_text().splitlines()][:]
    assert told and sum(new for _, new in told) == 60 - len(committed)
    again = [t for t, _ in after]
    assert len(committed) > 5 and all(again.count(h[1:]) == 1 for h in committed) and len(before) < len(after)
    units = spark.createDataFrame([(f"h{t}", "c") for t in texts], "text_sha256 string, course string")
    row = M.coverage(units, M.stored(spark, str(tmp_path / "store")), "course").first()
    assert (row.total, row.embedded, row.truncated) == (65, 65, 9)
    assert run() == [] and all(cut == (len(t) > 100) for t, cut in after)


@pytest.mark.parametrize("wrong", [[[1.0]], [[1.0, float("nan")]], []])
def test_wrong_vectors(wrong):
    with pytest.raises(ValueError):
        list(M.batch_vectors(["a"], lambda texts, cut: wrong, 2))


def plain(reviews, w=S.WEIGHTS, learning=(60, 600), relearning=(600,)):
    """The model step by step in Python."""
    from math import exp

    decay = -w[20]
    factor = 0.9 ** (1 / decay) - 1
    clamp = lambda d: min(max(d, 1.0), 10.0)
    first = lambda r: w[4] - exp(w[5] * (r - 1)) + 1
    state, step, s, d, last, due = 0, 0, None, None, None, None
    for at, r in reviews:
        if state == 0:
            s, d, state = max(w[r - 1], 0.001), clamp(first(r)), 1
        else:
            days = (at - last) // 86_400
            if days < 1:
                grow = exp(w[17] * (r - 3 + w[18])) * s ** -w[19]
                new = s * (max(grow, 1.0) if r >= 3 else grow)
            else:
                p = (1 + factor * days / s) ** decay
                if r == 1:
                    new = min(w[11] * d ** -w[12] * ((s + 1) ** w[13] - 1) * exp((1 - p) * w[14]), s / exp(w[17] * w[18]))
                else:
                    new = s * (1 + exp(w[8]) * (11 - d) * s ** -w[9] * (exp((1 - p) * w[10]) - 1) * {2: w[15], 4: w[16]}.get(r, 1))
            d = clamp(w[7] * first(4) + (1 - w[7]) * (d + (10 - d) * (-w[6] * (r - 3)) / 9))
            s = max(new, 0.001)
        wait = min(max(round(s / factor * (0.9 ** (1 / decay) - 1)), 1), 36_500) * 86_400
        steps = {1: learning, 2: (), 3: relearning}[state]
        if state == 2 and r == 1 and relearning:
            state, step, wait = 3, 0, relearning[0]
        elif steps and step < len(steps) and r == 1:
            step, wait = 0, steps[0]
        elif steps and step < len(steps) and r == 2:
            wait = (steps[0] * 1.5 if len(steps) == 1 else (steps[0] + steps[1]) / 2) if step == 0 else steps[step]
        elif steps and r == 3 and step + 1 < len(steps):
            step += 1
            wait = steps[step]
        else:
            state, step = 2, None
        last, due = at, at + int(wait)
    return state, step, s, d, last, due


def test_schedule(spark):
    import random

    rng = random.Random(1)
    cards = {c: [] for c in range(60)}
    for own in cards.values():
        at = 1_700_000_000
        for _ in range(rng.randrange(1, 25)):
            at += rng.choice([30, 600, 86_400, 10 * 86_400, rng.randrange(1, 200 * 86_400)])
            own.append((at, rng.choice([1, 2, 3, 3, 3, 4])))
    frame = spark.createDataFrame([(c, at, n, r) for c, own in cards.items() for n, (at, r) in enumerate(own)], "card long, at long, n long, rating int")
    for scheduler, settings in ((S.Scheduler(), {}), (S.Scheduler(learning=(), relearning=()), {"learning": (), "relearning": ()}), (S.Scheduler(learning=(60, 120, 300), relearning=(600, 700)), {"learning": (60, 120, 300), "relearning": (600, 700)})):
        for r in S.scheduled(frame, "card", scheduler).collect():
            state, step, s, d, last, due = plain(cards[r.card], **settings)
            assert (r.state, r.step, r.last, r.due, r.reviews) == (state, step, last, due, len(cards[r.card])) and r.stability == pytest.approx(s) and r.difficulty == pytest.approx(d)
    minute = {r: plain([(0, r)]) for r in (1, 2, 3, 4)}
    assert [minute[r][5] for r in (1, 2, 3)] == [60, 330, 600] and minute[4][0] == 2  # the first answer of a new card
