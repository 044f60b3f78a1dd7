from cartolith.streaming import interactive

SCHEMA = "user_id bigint, event_id bigint, ts bigint, action string, point bigint, level string"


def test_sessions():
    run = lambda *events: [interactive.step(s, a, v) for s, a, v in events]
    assert run(((None, None, "LOW"), "TAP", 1), ((1, None, "LOW"), "TAP", 2), ((1, 2, "LOW"), "TAP", 3)) == [((1, None, "LOW"), None), ((1, 2, "HIGH"), 6.0), ((3, None, "LOW"), None)]
    assert run(((1, 2, "LOW"), "UNDO", None), ((1, None, "LOW"), "UNDO", None), ((None, None, "LOW"), "UNDO", None)) == [((1, None, "LOW"), None), ((None, None, "LOW"), None), ((None, None, "LOW"), None)]
    assert run(((1, 2, "HIGH"), "LEVEL", "LOW"), ((1, None, "HIGH"), "LEVEL", "LOW"), ((1, 2, "HIGH"), "LEVEL", "?")) == [((1, 2, "LOW"), 1.0), ((1, None, "LOW"), None), ((1, 2, "HIGH"), None)]


def events(spark, n=90):
    actions = ["TAP", "TAP", "LEVEL", "UNDO", "SET_END", "SET_START", "TAP"]
    rows = [(i % 4, i, 1000 * i, actions[i * 5 % 7], None if i % 9 == 0 else i, ["LOW", "MEDIUM", "HIGH"][i % 3]) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_stream_equals_batch(spark, tmp_path):
    df = events(spark)
    for k in range(3):
        df.where(f"event_id between {30 * k} and {30 * k + 29}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = interactive.sessions_stream(stream).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.awaitTermination(120)
    got = sorted(map(str, spark.table("sessions").collect()))
    assert got == sorted(map(str, interactive.sessions(df).collect())) and len(got) == 90


def test_sessions_over_many_ranges(spark):
    """One user has most events, so most ranges begin within it."""
    import random

    r = random.Random(3)
    actions = ["TAP", "TAP", "TAP", "UNDO", "SET_START", "SET_END", "LEVEL", "OTHER"]
    rows = [(r.choice([7, 7, 7, 7, 8, 9, None]), i, r.randrange(500), r.choice(actions), r.choice([None, i, -1, 0]), r.choice(["LOW", "MEDIUM", "HIGH", "?"])) for i in range(3000)]
    want, states = [], {}
    for user, event, _, action, point, level in sorted(rows, key=lambda x: (x[2], x[1])):
        state, weight = interactive.step(states.get(user, interactive.FIRST), action, level if action == "LEVEL" else point)
        states[user] = state
        want.append((user, event, action, state[0], state[1], weight))
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (1, 23):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert sorted(map(tuple, interactive.sessions(df).collect()), key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert interactive.sessions(df.limit(0)).count() == 0


def test_idle_state_goes():
    """The streamed fold sets a time-out with each batch and forgets when it comes."""
    import pandas as pd

    seen = []

    class Events:
        def groupBy(self, key):
            return self

        def applyInPandasWithState(self, run, *rest):
            return run

    class Group:
        hasTimedOut, exists = False, False

        def update(self, state):
            seen.append(state)

        def setTimeoutDuration(self, ms):
            seen.append(ms)

        def remove(self):
            seen.append("gone")

    run = interactive.sessions_stream(Events(), idle_ms=50)
    row = pd.DataFrame([(1, 1, 0, "TAP", 5, None)], columns=["user_id", "event_id", "ts", "action", "point", "level"])
    assert list(run((1,), iter([row]), Group()))[0]["start"].tolist() == [5]
    late = Group()
    late.hasTimedOut = True
    assert len(list(run((1,), iter([]), late))[0]) == 0 and seen == [(5, None, "HIGH"), 50, "gone"]


def test_restored_states(spark):
    rows = [(1, 5, 6, "LOW"), (2, 5, None, "MEDIUM"), (3, None, 6, "HIGH"), (4, 7, 8, "odd"), (5, 1, 2, None)]
    got = interactive.restored(spark.createDataFrame(rows, "user_id bigint, start bigint, end bigint, level string")).orderBy("user_id").collect()
    assert [(r.plans, r.weight, r.level) for r in got] == [(True, 1.0, "LOW"), (False, None, "MEDIUM"), (False, None, "HIGH"), (True, 6.0, "HIGH"), (True, 6.0, "HIGH")]


def test_streamed_debounce_equals_batch(spark, tmp_path):
    import datetime as dt
    import random

    r = random.Random(4)
    begin = dt.datetime(2026, 1, 1)
    rows, at = [], 0
    for i in range(120):
        at += r.choice([20, 90, 181, 400])
        rows.append((i % 3, i, begin + dt.timedelta(milliseconds=at), r.choice("ab")))
    rows.append((99, 999, begin + dt.timedelta(hours=1), "moves the watermark on"))
    df = spark.createDataFrame(rows, "user_id bigint, event_id bigint, at timestamp, query string")
    for k in range(3):
        df.where(f"event_id div 40 = {k}" + (" or event_id = 999" if k == 2 else "")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = interactive.debounce_stream(stream).writeStream.format("memory").queryName("settled").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.awaitTermination(120)
    want = interactive.debounce(df.where("user_id <> 99").selectExpr("user_id", "event_id", "unix_millis(at) as ts", "query"))
    assert sorted(map(tuple, spark.table("settled").collect())) == sorted(map(tuple, want.collect()))


def test_debounce_and_latest(spark):
    q = spark.createDataFrame([(1, 1, 0, "a"), (1, 2, 100, "ab"), (1, 3, 281, "ab"), (1, 4, 600, "ab"), (1, 5, 900, "c"), (2, 6, 0, "x")], "user_id bigint, event_id bigint, ts bigint, query string")
    assert sorted((r.user_id, r.event_id) for r in interactive.debounce(q).collect()) == [(1, 2), (1, 5), (2, 6)]
    r = spark.createDataFrame([(1, 1, "old"), (1, 3, "new"), (1, 2, "late")], "user_id bigint, request_seq bigint, result string")
    assert interactive.latest(r).first().result == "new"


def test_windows_stream(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2026, 1, 1)
    rows = [(t + dt.timedelta(minutes=m), "a" if m % 2 else "b", 1.0) for m in range(30)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = interactive.watched_minutes(stream).writeStream.format("memory").queryName("minutes").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("minutes").collect())) == sorted(map(str, interactive.watched_minutes(df).collect()))
