"""Folds of the events table, and incremental plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds as E
from ..operators import scheduling as S
from ..sources.tables import scratch
from ..streaming import logs, watches

ORDER = ["ts", "event_id"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _kinds(rows: DataFrame) -> DataFrame:
    """Events of (user, hour of the day) as cards: sign-ups create, views and clicks edit, errors suspend, some errors delete."""
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'reviewed' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'deleted' ELSE 'suspended' END ELSE 'edited' END")
    return rows.select((F.col("user_id") * 24 + F.hour("ts")).alias("card"), "ts", "event_id", F.col("value"), kind.alias("kind"))


_KINDS = """WITH k AS (SELECT user_id * 24 + hour(ts) AS card, ts, event_id, value, row_number() OVER (ORDER BY ts, event_id) AS seq,
CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'reviewed' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'deleted' ELSE 'suspended' END ELSE 'edited' END AS kind FROM events)
"""


def event_fold(spark, sf_dir):
    rows = _kinds(_events(spark, sf_dir))
    return E.folded_cards(rows.where("kind <> 'reviewed'"), "card", ORDER, rows.where("kind = 'reviewed'"))


def state_changes(spark, sf_dir):
    return E.changes(_events(spark, sf_dir), "user_id", ORDER, F.col("event_type")).select("user_id", "event_id", F.col("event_type"))


def job_states(spark, sf_dir):
    last = E.latest(_events(spark, sf_dir), ["user_id"], F.desc("ts"), F.desc("event_id"))
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'finished' ELSE event_type END")
    return last.select("user_id", E.transition(kind).alias("state"))


def _cards(spark, sf_dir) -> DataFrame:
    """A card for each user: due a day after the last purchase, if there is one; suspended where the last event is an error."""
    return _events(spark, sf_dir).groupBy(F.col("user_id").alias("card")).agg(
        (F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))) + F.expr("INTERVAL 1 DAY")).alias("due"), (F.max_by("event_type", F.struct(*ORDER)) == "error").alias("suspended")
    )


_CARDS = """WITH cards AS (SELECT user_id AS card, max(ts) FILTER (event_type = 'purchase') + INTERVAL 1 DAY AS due, arg_max(event_type, (ts, event_id)) = 'error' AS suspended FROM events GROUP BY user_id)
"""
_NOW = "TIMESTAMP_NTZ '2024-01-29 12:00:00'"


def due_queue(spark, sf_dir):
    return E.due_queue(_cards(spark, sf_dir), F.expr(_NOW), 5).select("card", "part", F.date_format("due", "yyyy-MM-dd HH:mm:ss").alias("due"))


def deck_summary(spark, sf_dir):
    rows = _cards(spark, sf_dir).withColumn("deck", F.col("card") % 7)
    return rows.groupBy("deck").agg(
        F.count_if(F.expr(f"not suspended and due <= {_NOW}")).alias("due"), F.count_if(F.expr("not suspended")).alias("active"), F.date_format(F.min(F.expr(f"CASE WHEN not suspended AND due > {_NOW} THEN due END")), "yyyy-MM-dd HH:mm:ss").alias("next_due")
    )


def reconcile_plan(spark, sf_dir):
    """Two snapshots of documents: the index has what isn't divisible by 5, as it was; of the table some are gone, changed or unreadable."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("hash"))
    current = docs.where("doc_id % 7 <> 0").withColumn("hash", F.expr("CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN concat(hash, 'x') ELSE hash END"))
    return E.reconcile(current, docs.where("doc_id % 5 <> 0"), "doc_id", "hash")


def backfill_plan(spark, sf_dir):
    """Sources with units that no vector covers, and how many."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", F.sha2("text", 256).alias("hash"))
    have = docs.where("doc_id % 3 <> 0").select("hash").distinct()
    return docs.join(have, "hash", "left_anti").groupBy("source").agg(F.count("*").alias("missing")).where("missing > 10")


def link_cooldowns(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_type") != "error").alias("ok"))
    return E.cooldowns(rows, "user_id", "at", 2, 86400.0)


_LINK = "CASE event_type WHEN 'click' THEN 'ok' WHEN 'view' THEN 'rate_limit' WHEN 'purchase' THEN 'busy' WHEN 'error' THEN 'unreachable' ELSE CASE WHEN event_id % 200 = 0 THEN 'refused' ELSE 'unreachable' END END"


def link_states(spark, sf_dir):
    """Events as calls of a link by each user, pauses in hours."""
    rows = _events(spark, sf_dir).select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"), F.col("event_id").alias("n"), F.expr(_LINK).alias("kind"), F.expr("CASE WHEN event_id % 2 = 0 THEN floor(value) * 60 END").alias("retry_after"))
    return E.link_states(rows, "user_id", "at", 3, {"rate_limit": 3600.0, "busy": 1800.0}, 7200.0)


def card_duplicates(spark, sf_dir):
    """Drafts (of views) whose key a live card has."""
    drafts = _kinds(_events(spark, sf_dir).where("event_type = 'view'")).groupBy("card").agg(F.count("*").alias("drafts"))
    return drafts.join(event_fold(spark, sf_dir).select("card"), "card", "left_semi")


def latest_then_filter(spark, sf_dir):
    """Of each (order, line) the last answer; of these the wrong ones. An answer that is right later hides a mistake."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ties = [F.desc(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")]
    last = E.latest(rows, ["l_orderkey", "l_linenumber"], *ties)
    return last.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def progress(spark, sf_dir):
    """Speed and time left of each user's events against 100."""
    rows = _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("done"), (F.unix_micros(F.max("ts").cast("timestamp")) / 1e6 - F.unix_micros(F.min("ts").cast("timestamp")) / 1e6).alias("s"))
    return rows.select("user_id", "done", F.round(F.col("done") * 3600 / F.col("s"), 6).alias("per_hour"), F.round(F.greatest(F.lit(0), 100 - F.col("done")) * F.col("s") / F.col("done"), 3).alias("left_s"))


#: Silence before a ping, and how late events may come, in milliseconds.
_PING, _DELAY = 36 * 3600 * 1000, 3600 * 1000


def state_watch(spark, sf_dir):
    """Each user's events as a stream: changes of type, pings in between, the end with every 40th event."""
    path = scratch(spark, "events")
    rows = _events(spark, sf_dir).withColumn("time", F.col("ts").cast("timestamp"))
    rows.repartitionByRange(3, "ts").write.parquet(path)  # files as they would be appended
    with logs.settings(spark, watches.STATE_STORE):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)
        told = watches.watched(stream, "user_id", "time", "event_id", F.col("event_type"), F.col("event_id") % 40 == 0, f"{_DELAY} milliseconds", _PING)
        out = scratch(spark, "watch")
        logs.to_table(told, out, scratch(spark, "watch-state"))
    return spark.read.schema(watches.TOLD).parquet(out).select(F.col("key").alias("user_id"), "at", "event", "state")


def card_schedule(spark, sf_dir):
    """Each user's events as reviews of a card, rated by their type."""
    rating = F.expr("CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 4 ELSE 3 END")
    rows = _events(spark, sf_dir).select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("n"), rating.alias("rating"))
    return S.scheduled(rows, "user_id").select("user_id", "reviews", "state", "step", F.round("stability", 6).alias("stability"), F.round("difficulty", 6).alias("difficulty"), "due")


QUERIES = {f.__name__: f for f in (event_fold, state_changes, job_states, due_queue, deck_summary, reconcile_plan, backfill_plan, link_cooldowns, link_states, card_duplicates, latest_then_filter, progress, state_watch, card_schedule)}
ORACLES = {
    "event_fold": _KINDS
    + """, b AS (SELECT *, max(seq) FILTER (kind = 'created') OVER (PARTITION BY card) AS born, max(seq) FILTER (kind = 'deleted') OVER (PARTITION BY card) AS died FROM k WHERE kind <> 'reviewed'),
l AS (SELECT card, arg_max(value, seq) FILTER (kind IN ('created', 'edited')) AS value, count(*) FILTER (kind = 'edited') AS edits, count(*) FILTER (kind = 'suspended') > 0 AS suspended FROM b WHERE born IS NOT NULL AND coalesce(died, 0) < born AND seq >= born GROUP BY card),
v AS (SELECT card, arg_max(value, seq) AS review, count(*) AS reviews FROM k WHERE kind = 'reviewed' GROUP BY card)
SELECT card, value, edits, suspended, review, coalesce(reviews, 0) AS reviews FROM l LEFT JOIN v USING (card)""",
    "link_states": f"""WITH RECURSIVE o AS (SELECT user_id, epoch(ts)::DOUBLE AS sec, {_LINK} AS kind, CASE WHEN event_id % 2 = 0 THEN floor(value) * 60 END AS retry, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT, event_id) AS i FROM events),
r AS (SELECT DISTINCT user_id, 0 AS i, false AS disabled, -1e18 AS until, 0 AS failures, 0 AS skipped FROM o
UNION ALL SELECT o.user_id, o.i, r.disabled OR (c AND kind = 'refused'),
  CASE WHEN c AND kind = 'rate_limit' THEN floor(sec) + coalesce(retry, 3600) WHEN c AND kind = 'busy' THEN floor(sec) + coalesce(retry, 1800) WHEN c AND kind = 'unreachable' AND failures + 1 >= 3 THEN floor(sec) + 7200 ELSE r.until END,
  CASE WHEN NOT c THEN failures WHEN kind = 'ok' THEN 0 WHEN kind = 'unreachable' THEN CASE WHEN failures + 1 >= 3 THEN 0 ELSE failures + 1 END ELSE failures END, CASE WHEN c THEN skipped ELSE skipped + 1 END
FROM (SELECT r.*, NOT r.disabled AND floor(o.sec) >= r.until AS c, o.i AS next FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1) r JOIN o ON o.user_id = r.user_id AND o.i = r.next)
SELECT user_id, arg_max(disabled, i) AS disabled, arg_max(until, i) AS until, arg_max(failures, i) AS failures, arg_max(skipped, i) AS skipped FROM r GROUP BY user_id""",
    "state_changes": "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type",
    "job_states": "SELECT user_id, CASE k WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'interrupted' WHEN 'purchase' THEN 'done' ELSE k END AS state FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS k FROM events GROUP BY user_id)",
    "due_queue": _CARDS + """SELECT card, 0 AS part, strftime(due, '%Y-%m-%d %H:%M:%S') AS due FROM cards WHERE NOT suspended AND due <= TIMESTAMP '2024-01-29 12:00:00'
UNION ALL (SELECT card, 1, NULL FROM cards WHERE NOT suspended AND due IS NULL ORDER BY card LIMIT 5)""",
    "deck_summary": _CARDS + """SELECT card % 7 AS deck, count(*) FILTER (NOT suspended AND due <= TIMESTAMP '2024-01-29 12:00:00') AS due, count(*) FILTER (NOT suspended) AS active,
strftime(min(due) FILTER (NOT suspended AND due > TIMESTAMP '2024-01-29 12:00:00'), '%Y-%m-%d %H:%M:%S') AS next_due FROM cards GROUP BY card % 7""",
    "reconcile_plan": """WITH d AS (SELECT doc_id, sha256(text) AS hash FROM documents), n AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN hash || 'x' ELSE hash END AS new, true AS there FROM d WHERE doc_id % 7 <> 0),
o AS (SELECT doc_id, hash AS old, true AS has FROM d WHERE doc_id % 5 <> 0)
SELECT doc_id, CASE WHEN there IS NULL THEN 'delete' WHEN new IS NULL THEN CASE WHEN has THEN 'keep' ELSE 'skip' END WHEN has IS NULL THEN 'add' WHEN new <> old THEN 'replace' ELSE 'keep' END AS action FROM n FULL JOIN o USING (doc_id)""",
    "backfill_plan": """WITH d AS (SELECT source, doc_id, sha256(text) AS hash FROM documents)
SELECT source, count(*) AS missing FROM d WHERE hash NOT IN (SELECT hash FROM d WHERE doc_id % 3 <> 0) GROUP BY source HAVING count(*) > 10""",
    "link_cooldowns": """WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) / 1e6 AS sec, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type <> 'error') AS i FROM events),
r AS (SELECT user_id, i, sec, CASE WHEN ok THEN 0 ELSE 1 END AS n, -1e18 AS until, false AS shuts FROM o WHERE i = 1
UNION ALL SELECT o.user_id, o.i, o.sec,
CASE WHEN o.sec < r.until THEN r.n WHEN o.ok THEN 0 WHEN r.n + 1 >= 2 THEN 0 ELSE r.n + 1 END,
CASE WHEN o.sec >= r.until AND NOT o.ok AND r.n + 1 >= 2 THEN o.sec + 86400 ELSE r.until END,
o.sec >= r.until AND NOT o.ok AND r.n + 1 >= 2 FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT user_id, sec AS shut FROM r WHERE shuts""",
    "latest_then_filter": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC) AS n FROM lineitem) WHERE n = 1 AND l_returnflag = 'R'""",
    "state_watch": f"""WITH w AS (SELECT max(epoch_us(ts) // 1000) - {_DELAY} AS upto FROM events),
e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_id, event_type AS state, event_id % 40 = 0 AS terminal, upto FROM events, w WHERE epoch_us(ts) // 1000 <= upto),
o AS (SELECT *, row_number() OVER o AS i, lag(state) OVER o IS DISTINCT FROM state AS changed FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ms, event_id)),
f AS (SELECT *, min(i) FILTER (terminal) OVER (PARTITION BY user_id) AS last FROM o), k AS (SELECT * FROM f WHERE last IS NULL OR i <= last),
c AS (SELECT user_id, ms, state, last, upto, lead(ms) OVER (PARTITION BY user_id ORDER BY i) AS next, max(ms) FILTER (i = last) OVER (PARTITION BY user_id) AS ended FROM (SELECT * FROM k WHERE changed OR i = last) WHERE changed OR last IS NOT NULL),
p AS (SELECT user_id, ms, 'progress' AS event, state FROM k WHERE changed UNION ALL SELECT user_id, ms, 'end', state FROM k WHERE i = last
UNION ALL SELECT user_id, unnest(range(ms + {_PING}, CASE WHEN next IS NOT NULL THEN next WHEN ended IS NOT NULL THEN ms ELSE upto + 1 END, {_PING})), 'ping', NULL FROM c)
SELECT user_id, ms AS "at", event, state FROM p""",
    "progress": """SELECT user_id, done, round(done * 3600 / s, 6) AS per_hour, round(greatest(0, 100 - done) * s / done, 3) AS left_s
FROM (SELECT user_id, count(*) AS done, epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6 AS s FROM events GROUP BY user_id)""",
}
ORACLES["card_duplicates"] = f"WITH f AS ({ORACLES['event_fold']}) SELECT card, count(*) AS drafts FROM (SELECT user_id * 24 + hour(ts) AS card FROM events WHERE event_type = 'view') WHERE card IN (SELECT card FROM f) GROUP BY 1"
_W = S.WEIGHTS
_DECAY, _FACTOR = S.Scheduler().decay, S.Scheduler().factor
_DAYS = f"least(greatest(round_even(s / {_FACTOR!r} * {0.9 ** (1 / _DECAY) - 1!r}, 0), 1), 36500)"
ORACLES["card_schedule"] = f"""WITH RECURSIVE o AS (SELECT user_id, floor(epoch(ts))::BIGINT AS sec, CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 4 ELSE 3 END AS g,
row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS i FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 0 AS state, 0 AS step, NULL::DOUBLE AS s, NULL::DOUBLE AS d, NULL::BIGINT AS sec, NULL::BIGINT AS due FROM o
UNION ALL SELECT user_id, i, CASE WHEN done THEN 2 WHEN state = 2 THEN 3 WHEN state = 0 THEN 1 ELSE state END, CASE WHEN done THEN NULL WHEN g = 1 OR state = 2 THEN 0 WHEN g = 2 THEN step ELSE step + 1 END, s, d, sec,
  sec + CASE WHEN done THEN ({_DAYS} * 86400)::BIGINT WHEN state IN (2, 3) THEN CASE g WHEN 2 THEN 900 ELSE 600 END WHEN g = 1 THEN 60 WHEN g = 2 THEN CASE step WHEN 0 THEN 330 ELSE 600 END ELSE 600 END
FROM (SELECT user_id, i, sec, g, state, step, CASE state WHEN 2 THEN g > 1 WHEN 3 THEN g > 2 ELSE g = 4 OR g = 3 AND step = 1 END AS done,
    CASE WHEN s IS NULL THEN [{_W[0]}, {_W[1]}, {_W[2]}, {_W[3]}][g] ELSE greatest(0.001, CASE WHEN days < 1 THEN s * CASE WHEN g > 2 THEN greatest(1, grown) ELSE grown END
      WHEN g = 1 THEN least({_W[11]} * pow(d, -{_W[12]}) * (pow(s + 1, {_W[13]}) - 1) * exp((1 - p) * {_W[14]}), s / exp({_W[17]} * {_W[18]}))
      ELSE s * (1 + exp({_W[8]}) * (11 - d) * pow(s, -{_W[9]}) * (exp((1 - p) * {_W[10]}) - 1) * CASE g WHEN 2 THEN {_W[15]} WHEN 4 THEN {_W[16]} ELSE 1 END) END) END AS s,
    least(10, greatest(1, CASE WHEN s IS NULL THEN {_W[4]} - exp({_W[5]} * (g - 1)) + 1 ELSE {_W[7]} * ({_W[4]} - exp({_W[5]} * 3) + 1) + (1 - {_W[7]}) * (d + (10 - d) * (-{_W[6]} * (g - 3)) / 9) END)) AS d
  FROM (SELECT o.user_id, o.i, o.sec, g, state, step, s::DOUBLE AS s, d::DOUBLE AS d, days, exp({_W[17]} * (g - 3 + {_W[18]})) * pow(s, -{_W[19]}) AS grown, pow(1 + {_FACTOR!r} * days / s, {_DECAY!r}) AS p
    FROM (SELECT r.*, o.sec AS now, g, (o.sec - r.sec) // 86400 AS days, o.i AS next FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1) r JOIN (SELECT user_id, i, sec FROM o) o ON o.user_id = r.user_id AND o.i = r.next)))
SELECT user_id, max(i) AS reviews, arg_max(state, i) AS state, arg_max_null(step, i) AS step, round(arg_max(s, i), 6) AS stability, round(arg_max(d, i), 6) AS difficulty, arg_max(due, i) AS due FROM r GROUP BY user_id"""
