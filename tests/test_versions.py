"""The stored table, versions, the stepped production and the rounds of corrections, against plain versions."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioflow.operators import corrections, versions
from folioflow.sources.store import Conflict, Store
from folioflow.streaming import events, production

SCHEMA = "id long, work string, text string, made int"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/t", SCHEMA, "id", "work", ("made",), buckets=4)


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def content(store, version=None):
    return sorted(tuple(r) for r in store.read(version).collect())


def test_upserts_by_group(spark, store):
    first = [(i, f"w{i % 5}", f"t{i}", 1) for i in range(50)] + [(100, None, None, 1)]
    assert content(store) == [] and store.upsert(rows(spark, [])) == (None, 0)
    assert store.upsert(rows(spark, first)) == (1, 4)
    assert store.upsert(rows(spark, first)) == (1, 0)
    # carried columns alone are no change; another order of rows and columns neither
    again = rows(spark, [(*r[:3], 9) for r in reversed(first)]).select("made", "text", "id", "work")
    assert store.upsert(again) == (1, 0) and store.versions() == [1]
    second = [(1, "w1", "new", 2), (11, "w1", "t11", 2), (60, "w1", "added", 2), (2, "w1", "moved here", 2), (100, None, "said", 2)]
    version, written = store.upsert(rows(spark, second))
    want = {r[0]: r for r in first if r[1] not in ("w1", None)}
    want |= {1: (1, "w1", "new", 1), 11: (11, "w1", "t11", 1), 60: (60, "w1", "added", 2), 2: (2, "w1", "moved here", 1), 100: (100, None, "said", 1)}
    assert version == 2 and content(store) == sorted(want.values()) and content(store, 1) == sorted(first)
    assert store.upsert(rows(spark, second)) == (2, 0)


def test_a_bucket_can_become_empty(spark, store):
    store.upsert(rows(spark, [(i, "w", "t", 1) for i in range(40)]))
    store.upsert(rows(spark, [(7, "w", "t", 2)]))
    assert content(store) == [(7, "w", "t", 1)]


def test_a_killed_write_leaves_the_old_version(spark, store, monkeypatch):
    store.upsert(rows(spark, [(1, "w", "a", 1)]))
    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            store.upsert(rows(spark, [(1, "w", "b", 1)]))
    assert store.versions() == [1] and content(store) == [(1, "w", "a", 1)]
    assert store.upsert(rows(spark, [(1, "w", "b", 1)])) == (2, 1) and content(store) == [(1, "w", "b", 1)]


def test_two_writers_make_one_version(spark, store, monkeypatch):
    store.upsert(rows(spark, [(1, "w", "a", 1)]))
    real, seen = Store._commit, []

    def other_first(self, number, places):
        if not seen:
            seen.append(1)
            Store(spark, self.path, SCHEMA, "id", "work", ("made",), buckets=4).upsert(rows(spark, [(2, "v", "theirs", 1)]))
        real(self, number, places)

    monkeypatch.setattr(Store, "_commit", other_first)
    with pytest.raises(Conflict):
        store.upsert(rows(spark, [(1, "w", "mine", 1)]))
    assert content(store) == [(1, "w", "a", 1), (2, "v", "theirs", 1)]
    assert store.upsert(rows(spark, [(1, "w", "mine", 1)])) == (3, 1)


@pytest.mark.parametrize("bad", [[(1, "w", "a", 1), (1, "v", "b", 1)], [(None, "w", "a", 1)]])
def test_keys_must_be_unique(spark, store, bad):
    with pytest.raises(ValueError, match="key id"):
        store.upsert(rows(spark, bad))
    with pytest.raises(ValueError, match="the table has"):
        store.upsert(rows(spark, bad).withColumn("extra", F.lit(1)))


def test_stream_into_a_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/t", "k long, at int, v string", "k", "k", buckets=2)
    write = events.upserting(store, ["at"])
    frame = lambda data: spark.createDataFrame(data, "k long, at int, v string")
    write(frame([(1, 1, "a"), (1, 3, "c"), (2, 1, "x")]), 0)
    write(frame([(1, 1, "a"), (1, 3, "c"), (2, 1, "x")]), 0)  # the same batch again
    assert store.versions() == [1]
    write(frame([(1, 2, "late"), (2, 5, "y")]), 1)
    assert sorted(tuple(r) for r in store.read().collect()) == [(1, 3, "c"), (2, 5, "y")] and store.versions() == [1, 2]


# ---- versions


def test_versions_and_history(spark):
    from datetime import datetime, timedelta

    rng = random.Random(3)
    data = [(rng.choice([1, 1, 1, 2, None]), rng.choice("ab"), rng.choice("xyz"), datetime(2024, 1, 1) + timedelta(hours=rng.randrange(300)), n) for n in range(600)]
    made = spark.createDataFrame(data, "edition long, kind string, hash string, at timestamp_ntz, run long").repartition(4)
    groups = defaultdict(list)
    for e, k, h, at, run in data:
        groups[e, k].append((at, run, h))
    want_history, want_versions = [], []
    for (e, k), g in groups.items():
        g.sort()
        begun = [x for i, x in enumerate(g) if not i or g[i - 1][2] != x[2]]
        want_history += [(e, k, h, at, begun[i + 1][0] if i + 1 < len(begun) else None, run) for i, (at, run, h) in enumerate(begun)]
        order = list(dict.fromkeys(h for _, _, h in g))
        for n, h in enumerate(order, 1):
            mine = [x for x in g if x[2] == h]
            want_versions.append((e, k, h, n, mine[0][0], mine[-1][0], mine[-1][1], len(mine), h == g[-1][2]))
    assert sorted(map(tuple, versions.history(made).collect()), key=str) == sorted(want_history, key=str)
    got = sorted(map(tuple, versions.artifacts(made).collect()), key=str)
    assert got == sorted(want_versions, key=str)
    assert Counter((r[0], r[1]) for r in got if r[8]) == Counter(groups.keys())
    assert versions.history(made.limit(0)).count() == versions.artifacts(made.limit(0)).count() == 0


# ---- production


def test_moves():
    P = production
    c = lambda **x: P.Cursor(since=0, **x)
    assert P.advance(c(), 5, "done") == (P.Cursor(1, 1, 0, "", 5, 1), "next")
    assert P.advance(c(), 5, "wait")[0].since == 5
    assert P.advance(c(), 5, "failed")[0].starts == 2 and P.advance(c(starts=2), 5, "failed")[0].held == "failed"
    assert P.advance(c(step=5), 5, "back")[0].step == 3 and P.advance(c(step=5, rounds=5), 5, "back")[0].held == "rounds" and P.advance(c(step=2), 5, "back")[0].step == 2
    assert P.advance(c(held="failed"), 5, "done")[1] == "held" and P.advance(c(held="failed", step=4), 5, "go")[0].held == ""
    assert P.advance(c(step=9), 5, "done")[1] == "ready already" and P.Cursor(step=9).name == "ready"
    assert P.expire(c(), P.QUIET) is None and P.expire(c(), P.QUIET + 1)[0].held == "quiet" and P.expire(c(held="x"), 10**12) is None


def test_production_equals_its_replay_also_after_a_restart(spark, data, tmp_path):
    """The events come in three files and as many runs, each of which goes on from the checkpoint."""
    e = spark.read.parquet(f"{data}/events.parquet")
    cuts = [r[0] for r in e.selectExpr("percentile_approx(ts, array(0.3, 0.7)) c").select(F.explode("c")).collect()]
    parts = [e.filter(F.col("ts") < cuts[0]), e.filter((F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1])), e.filter(F.col("ts") >= cuts[1])]
    given = f"{tmp_path}/in"
    for n, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(given)
        raw = spark.readStream.schema(e.schema).parquet(given)
        moves = production.signals(raw.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour"))
        production.run(spark, production.produce(moves), f"file://{tmp_path}/run")
    log = spark.read.schema(production.LOG).parquet(f"{tmp_path}/run/log").toPandas()
    whole = production.signals(e.withColumn("at", F.col("ts").cast("timestamp")))
    upto = whole.agg(F.max("at_ms")).first()[0] - 3_600_000
    want = production.replay(whole, upto).toPandas()
    key = lambda f: sorted(map(str, f.astype(object).itertuples(index=False, name=None)))
    assert key(log) == key(want) and len(log) >= e.count()
    assert {"next", "sent back", "held after failures", "taken on"} <= set(log["note"])


def test_clock_holds_quiet_books(spark):
    day = 86_400_000
    frame = spark.createDataFrame([(1, 1, "done", 0), (1, 2, "done", 5 * day), (1, 3, "go", 6 * day), (2, 4, "wait", 0)], "book long, event long, move string, at_ms long")
    got = sorted(map(tuple, production.replay(frame, 7 * day).collect()), key=str)
    assert [r for r in got if r[0] == 1] == sorted([(1, 0, 1, "source", "done", "next"), (1, 3 * day, None, "probe", "clock", "quiet for too long"), (1, 5 * day, 2, "probe", "done", "held"), (1, 6 * day, 3, "probe", "go", "taken on")], key=str)
    assert (2, 3 * day, None, "source", "clock", "quiet for too long") in got


# ---- corrections


def test_rounds_against_a_loop(spark):
    import re

    rng = random.Random(4)
    data = [(e, c, b, " ".join(rng.choice(["word", "##", "%%%", "**", "%#", "longerwords", "extraordinarily", "at@@"]) for _ in range(rng.randint(0, 30)))) for e in range(12) for c in range(3) for b in range(4)]
    frame = spark.createDataFrame(data, "edition int, chapter int, block int, text string").repartition(3)
    judges = corrections.first_match(corrections.AGREE), corrections.first_match(corrections.ALSO)
    out = corrections.mend(corrections.settle(frame, judges), 560, lambda t: F.regexp_replace(t, "([^ ]{6})[^ ]{4,}", "$1"), lambda t: F.regexp_replace(t, "([^ ]{6})[^ ]+", "$1"))
    got = {(r["edition"], r["chapter"], r["block"]): (r["text"], r["applied"], r["rounds"], r["left"], r["tries"], r["verdict"]) for r in out.collect()}
    level = lambda texts: 100 * sum(len(t.replace(" ", "")) for t in texts) // max(1, sum(len(t.split(" ")) for t in texts if t))
    for e in range(12):
        for c in range(3):
            texts, applied, rounds = {b: t for x, y, b, t in data if (x, y) == (e, c)}, Counter(), 0
            agreed = lambda t: (m := re.search(corrections.AGREE, t)) and (n := re.search(corrections.ALSO, t)) and m[0] == n[0] and m or None
            while rounds < 5 and any(agreed(t) for t in texts.values()):
                rounds += 1
                for b, t in texts.items():
                    if m := agreed(t):
                        applied[b] += 1
                        texts[b] = t[: m.start()] + t[m.end() :]
            left = {b: int(agreed(t) is not None) for b, t in texts.items()}
            tries = 0
            if level(texts.values()) > 560:
                tries, texts = 1, {b: re.sub("([^ ]{6})[^ ]{4,}", r"\1", t) if level([t]) > 560 else t for b, t in texts.items()}
                if level(texts.values()) > 560:
                    tries, texts = 2, {b: re.sub("([^ ]{6})[^ ]+", r"\1", t) for b, t in texts.items()}
            verdict = "dropped" if level(texts.values()) > 560 else "mended" if tries else "holds"
            for b, t in texts.items():
                assert got[e, c, b] == (t, applied[b], rounds, left[b], tries, verdict), (e, c, b)
    assert {v[2] for v in got.values()} >= {0, 5} or {v[2] for v in got.values()} >= {5} and {v[5] for v in got.values()} > {"holds"}
    assert corrections.settle(frame.limit(0), judges).count() == 0
