"""Interaction streams: debounced searches, latest plans, taps.

Batch forms use windows over each user's events in order, or, where each event builds
on the one before, a scan: events lie in ranges of user and time, each range is summed
up as a function of the state before it, and a second pass knows that state. So a user
with a third of all events is as many ranges. Streamed forms keep state for each user,
until it is idle for so long, and give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import AVOIDANCE, DEBOUNCE_MS
from ..session import keep

#: Milliseconds after which an idle user's state goes.
IDLE_MS = 86_400_000


def debounce(queries: DataFrame, wait_ms: int = DEBOUNCE_MS) -> DataFrame:
    """user_id, ts, query of the searches that run: those that no other follows
    within wait_ms, and whose text differs from the one that ran before. ts in ms."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    settled = queries.withColumn("next_ts", F.lead("ts").over(w)).where(F.col("next_ts").isNull() | (F.col("next_ts") - F.col("ts") > wait_ms))
    return settled.withColumn("before", F.lag("query").over(w)).where(~F.col("query").eqNullSafe(F.col("before")) | F.col("before").isNull()).select("user_id", "event_id", "ts", "query")


def latest(results: DataFrame) -> DataFrame:
    """The result of each user's last request; stale ones are dropped."""
    return results.groupBy("user_id").agg(F.max_by("result", "request_seq").alias("result"), F.max("request_seq").alias("request_seq"))


def taps(events: DataFrame) -> DataFrame:
    """What each tap does, for users who only tap: first START, then END with a
    plan at level HIGH, then START again."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.withColumn("n", n).select("user_id", "event_id", F.when(F.col("n") % 2 == 1, "START").otherwise("END").alias("role"), (F.col("n") % 2 == 0).alias("plans"), F.when(F.col("n") % 2 == 0, F.lit(AVOIDANCE["HIGH"])).alias("weight"))


def debounce_stream(queries: DataFrame, wait_ms: int = DEBOUNCE_MS, late: str = "1 second") -> DataFrame:
    """The same from a stream of user_id, event_id, at (a timestamp) and query: the
    last search of a user waits in state until another follows, or until the watermark
    has passed it by wait_ms."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, parts: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        # (event_id, ts, query) that waits, and the query that ran last
        held, ran = (group.get[:3], group.get[3]) if group.exists else ((None, None, None), None)
        out = []

        def settle():
            nonlocal ran
            if held[0] is not None and (ran is None or held[2] != ran):
                out.append((key[0], *held))
            ran = held[2] if held[0] is not None else ran

        if group.hasTimedOut:
            settle()
            held = (None, None, None)
        else:
            for e in pd.concat(list(parts)).sort_values(["ts", "event_id"]).itertuples():
                if held[0] is not None and e.ts - held[1] > wait_ms:
                    settle()
                held = (int(e.event_id), int(e.ts), e.query)
        group.update((*held, ran))
        if held[0] is not None:
            group.setTimeoutTimestamp(max(held[1] + wait_ms + 1, group.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "ts", "query"])

    timed = queries.withWatermark("at", late).withColumn("ts", F.unix_millis("at"))
    return timed.groupBy("user_id").applyInPandasWithState(run, "user_id bigint, event_id bigint, ts bigint, query string", "event_id bigint, ts bigint, query string, ran string", "append", GroupStateTimeout.EventTimeTimeout)


_STATE = "start bigint, end_ bigint, level string"
_OUT = "user_id bigint, event_id bigint, action string, start bigint, end bigint, weight double"
FIRST = (None, None, "HIGH")


def step(state: tuple, action: str, value) -> tuple[tuple, float | None]:
    """One event on (start, end, level): the new state, and the weight to plan with,
    if it plans. TAP sets the start, then the end, then starts anew; UNDO takes the
    end back, then the start; LEVEL plans again where both are set; a new pair
    resets the level to HIGH."""
    start, end, level = state
    if action == "TAP":
        if start is None or end is not None:
            return (value, None, level), None
        return (start, value, "HIGH"), AVOIDANCE["HIGH"]
    if action == "UNDO":
        return ((start, None, level) if end is not None else (None, None, level)), None
    if action == "SET_START":
        return (value, end, "HIGH" if end is not None else level), AVOIDANCE["HIGH"] if end is not None else None
    if action == "SET_END":
        return (start, value, "HIGH" if start is not None else level), AVOIDANCE["HIGH"] if start is not None else None
    if action == "LEVEL" and value in AVOIDANCE:
        return (start, end, value), AVOIDANCE[value] if start is not None and end is not None else None
    return state, None


def restored(saved: DataFrame) -> DataFrame:
    """What a user's saved state (user_id, start, end, level) asks for when it comes
    back: a plan at the saved level where both ends are set; HIGH stands for a level
    that is none."""
    level = F.when(F.col("level").isin(*AVOIDANCE), F.col("level")).otherwise("HIGH")
    price = F.element_at(F.create_map(*[F.lit(x) for p in AVOIDANCE.items() for x in p]), F.col("level"))
    both = F.col("start").isNotNull() & F.col("end").isNotNull()
    return saved.withColumn("level", level).select("user_id", "start", "end", "level", both.alias("plans"), F.when(both, price).alias("weight"))


def _events(pdf: pd.DataFrame) -> Iterator[tuple]:
    """user, event_id, action, value of the events in order."""
    pdf = pdf.sort_values(["user_id", "ts", "event_id"])
    whole = lambda c: [None if pd.isna(v) else int(v) for v in pdf[c].tolist()]
    for user, event, action, point, level in zip(whole("user_id"), whole("event_id"), pdf["action"].tolist(), whole("point"), pdf["level"].tolist()):
        yield user, event, action, level if action == "LEVEL" else point


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["user_id", "event_id", "action", "start", "end", "weight"])
    return out.astype({"user_id": "Int64", "event_id": "Int64", "start": "Int64", "end": "Int64", "weight": "Float64"})


def _run(pdf: pd.DataFrame, entering: dict) -> tuple[list, dict]:
    """Rows of the events, and each user's state after them. entering: states before."""
    rows, states = [], dict(entering)
    for user, event, action, value in _events(pdf):
        state, weight = step(states.get(user, FIRST), action, value)
        states[user] = state
        rows.append((user, event, action, state[0], state[1], weight))
    return rows, states


#: Marks of the state before a range, and the shapes of it: a start and an end are set or not.
_START, _END, _LEVEL = "start", "end", "level"
_SHAPES = [(s, e, _LEVEL) for s in (None, _START) for e in (None, _END)]


def _summary(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a range: its first and last user, and the state of the last after it, for
    each shape of the state before: points are numbers, levels begin with =, and marks
    stand for what was there before."""
    import json

    events = list(_events(pdf))
    first, last = events[0][0], events[-1][0]
    ends = []
    for state in _SHAPES:
        for user, _, action, value in events:
            if user == last:
                state, _ = step(state, action, value)
        ends.append((*state[:2], state[2] if state[2] == _LEVEL else "=" + state[2]))
    out = pd.DataFrame([(key[0], first, last, json.dumps(ends))], columns=["part", "first_user", "last_user", "ends"])
    return out.astype({"first_user": "Int64", "last_user": "Int64"})


def _entering(summaries: list) -> dict[int, dict]:
    """The state of each range's first user before it."""
    import json

    out: dict[int, dict] = {}
    user, state = object(), FIRST
    for r in sorted(summaries, key=lambda r: r["part"]):
        before = state if r["first_user"] == user else FIRST
        out[r["part"]] = {r["first_user"]: before}
        if r["first_user"] != r["last_user"]:
            before = FIRST  # the last user's events begin in this range
        shape = json.loads(r["ends"])[2 * (before[0] is not None) + (before[1] is not None)]
        known = dict(zip((_START, _END, _LEVEL), before))
        state = tuple(x if not isinstance(x, str) else known[x] if x in known else x[1:] for x in shape)
        user = r["last_user"]
    return out


def sessions(events: DataFrame) -> DataFrame:
    """State after each event (user_id, event_id, ts, action, point, level), in the
    order of ts and event_id of each user. The driver sees one row a range."""
    dealt = events.select("user_id", "event_id", "ts", "action", "point", "level").repartitionByRange("user_id", "ts", "event_id").withColumn("part", F.spark_partition_id())
    dealt = keep(dealt, "session-ranges")
    found = dealt.groupBy("part").applyInPandas(_summary, "part int, first_user bigint, last_user bigint, ends string").collect()
    entering = _entering(found)

    def run(key, pdf):
        return _frame(_run(pdf, entering[key[0]])[0])

    return dealt.groupBy("part").applyInPandas(run, _OUT)


def sessions_stream(events: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """The same from a stream, with the state of each user kept between batches until
    no event of it has come for idle_ms."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, parts: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            yield _frame([])
            return
        state = tuple(None if pd.isna(x) else x for x in group.get) if group.exists else FIRST
        user = None if pd.isna(key[0]) else int(key[0])
        rows, states = _run(pd.concat(list(parts)), {user: state})
        group.update(states[user])
        group.setTimeoutDuration(idle_ms)
        yield _frame(rows)

    return events.groupBy("user_id").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def watched_minutes(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events and their value for each type and window of event time; later than
    the watermark is dropped when streamed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("window_start"), "n", "total")
