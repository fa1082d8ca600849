"""Folds of event logs, and plans for incremental work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def folded_cards(events: DataFrame, key: str, order: list[str], reviews: DataFrame) -> DataFrame:
    """The state of each live key.

    events: kind (created, edited, suspended, deleted), value. A creation starts afresh, a deletion ends; edits and
    suspensions count if the key is live. Then the last review of each live key applies, wherever it stands in the log.
    Folds to aggregates: what counts is after the last creation, and there may be no deletion after it.
    """
    at = F.struct(*order)
    when = lambda kind: F.max(F.when(F.col("kind") == kind, at))
    w = Window.partitionBy(key)
    rows = events.withColumn("born", F.max(F.when(F.col("kind") == "created", at)).over(w)).withColumn("died", F.max(F.when(F.col("kind") == "deleted", at)).over(w))
    rows = rows.where(F.col("born").isNotNull() & (F.col("died").isNull() | (F.col("died") < F.col("born"))) & (at >= F.col("born")))
    state = rows.groupBy(key).agg(
        F.max_by("value", F.when(F.col("kind").isin("created", "edited"), at)).alias("value"),
        F.count_if(F.col("kind") == "edited").alias("edits"),
        when("suspended").isNotNull().alias("suspended"),
    )
    last = reviews.groupBy(key).agg(F.max_by("value", at).alias("review"), F.count("*").alias("reviews"))
    return state.join(last, key, "left").withColumn("reviews", F.coalesce("reviews", F.lit(0)))


def changes(rows: DataFrame, key: str, order: list[str], state: Column) -> DataFrame:
    """Rows whose state differs from that of the row before."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("state", state).withColumn("before", F.lag("state").over(w)).where(~F.col("state").eqNullSafe(F.col("before")) | F.col("before").isNull())


def reconcile(current: DataFrame, indexed: DataFrame, key: str, version: str) -> DataFrame:
    """key, action: add, replace, delete or keep. Rows of current whose version is unreadable (null) keep what is indexed."""
    old = indexed.select(key, F.col(version).alias("old"), F.lit(True).alias("has"))
    new = current.select(key, F.col(version).alias("new"), F.lit(True).alias("there"))
    action = (
        F.when(F.col("there").isNull(), "delete")
        .when(F.col("new").isNull(), F.when(F.col("has"), "keep").otherwise("skip"))
        .when(F.col("has").isNull(), "add")
        .when(F.col("new") != F.col("old"), "replace")
        .otherwise("keep")
    )
    return new.join(old, key, "full").select(key, action.alias("action"))


def transition(kind: Column) -> Column:
    """A job's state after its last event; what was running when the log ends was interrupted."""
    return F.when(kind == "created", "queued").when(kind == "started", "interrupted").when(kind == "finished", "done").otherwise(kind)


def due_queue(cards: DataFrame, now: Column, new_limit: int) -> DataFrame:
    """Overdue cards by due time, then the first new ones (no due time). cards: card, due, suspended."""
    active = cards.where("not suspended")
    overdue = active.where(F.col("due") <= now).select("card", "due", F.lit(0).alias("part"))
    new = active.where("due is null").orderBy("card").limit(new_limit).select("card", "due", F.lit(1).alias("part"))
    return overdue.unionByName(new)


def cooldowns(failures: DataFrame, key: str, at: str, threshold: int, pause: float) -> DataFrame:
    """Times at which a link is shut: its threshold-th failure in a row, counting afresh after each pause.

    failures: key, at (seconds), ok. A success ends a row of failures; during a pause nothing is counted.
    """
    first = F.struct(F.array().cast("array<double>").alias("shut"), F.lit(0).alias("n"), F.lit(-1e18).alias("until"))

    def step(s, x):
        paused = x["at"] < s["until"]
        n = F.when(paused, s["n"]).when(x["ok"], F.lit(0)).otherwise(s["n"] + 1)
        shuts = ~paused & ~x["ok"] & (n >= threshold)
        return F.struct(
            F.when(shuts, F.concat(s["shut"], F.array(x["at"]))).otherwise(s["shut"]).alias("shut"), F.when(shuts, F.lit(0)).otherwise(n).alias("n"), F.when(shuts, x["at"] + pause).otherwise(s["until"]).alias("until")
        )

    rows = failures.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(at).cast("double").alias("at"), F.col("ok")))).alias("e"))
    return rows.select(key, F.explode(F.aggregate("e", first, step, lambda s: s["shut"])).alias("shut"))


def link_states(events: DataFrame, key: str, at: str, threshold: int = 3, pauses: dict[str, float] | None = None, pause: float = 120.0) -> DataFrame:
    """key, disabled, until, failures, skipped: the state of each link after its events, which count while it is neither disabled nor paused.

    events: key, at (seconds), n (order of equal times), kind, retry_after. ok ends a row of connectivity failures; refused disables the link; a kind in `pauses` pauses it for
    retry_after or its default; unreachable does so for `pause` at the threshold-th in a row. A link's events are folded in order.
    """
    pauses = pauses or {"rate_limit": 60.0, "busy": 30.0}
    first = F.struct(F.lit(False).alias("disabled"), F.lit(-1e18).alias("until"), F.lit(0).alias("failures"), F.lit(0).alias("skipped"))

    def step(s, x):
        counts = ~s["disabled"] & (x["at"] >= s["until"])
        n = s["failures"] + 1
        wait = F.coalesce(*[F.when(x["kind"] == kind, F.coalesce(x["retry_after"], F.lit(seconds))) for kind, seconds in pauses.items()], F.when((x["kind"] == "unreachable") & (n >= threshold), F.lit(pause)))
        failures = F.when(x["kind"] == "ok", F.lit(0)).when(x["kind"] == "unreachable", F.when(n >= threshold, F.lit(0)).otherwise(n)).otherwise(s["failures"])
        return F.struct(
            (s["disabled"] | (counts & (x["kind"] == "refused"))).alias("disabled"),
            F.when(counts & wait.isNotNull(), x["at"] + wait).otherwise(s["until"]).alias("until"),
            F.when(counts, failures).otherwise(s["failures"]).alias("failures"),
            F.when(counts, s["skipped"]).otherwise(s["skipped"] + 1).alias("skipped"),
        )

    order = F.struct(F.col(at).cast("double").alias("at"), "n", "kind", F.col("retry_after").cast("double").alias("retry_after"))
    return events.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("e")).select(key, F.aggregate("e", first, step).alias("s")).select(key, "s.*")
