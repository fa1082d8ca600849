"""When a card is due again: stability and difficulty of memory, after a published model (FSRS-6)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The model's default parameters.
WEIGHTS = (
    0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796,
    1.4835, 0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542,
)
AGAIN, HARD, GOOD, EASY = 1, 2, 3, 4
LEAST_STABILITY = 0.001
DAY = 86_400


@dataclass(frozen=True)
class Scheduler:
    """Parameters; steps in seconds. Intervals aren't spread by chance."""

    weights: tuple[float, ...] = WEIGHTS
    retention: float = 0.9
    learning: tuple[int, ...] = (60, 600)
    relearning: tuple[int, ...] = (600,)
    longest: int = 36_500

    @property
    def decay(self) -> float:
        return -self.weights[20]

    @property
    def factor(self) -> float:
        return 0.9 ** (1 / self.decay) - 1

    def retrievability(self, stability: Column, days: Column) -> Column:
        return F.pow(1 + self.factor * F.greatest(days, F.lit(0)) / stability, F.lit(self.decay))

    def days(self, stability: Column) -> Column:
        """Whole days until retrievability falls to what is wanted."""
        return F.least(F.greatest(F.rint(stability / self.factor * (self.retention ** (1 / self.decay) - 1)), F.lit(1.0)), F.lit(float(self.longest)))

    def first_stability(self, rating: Column) -> Column:
        return F.greatest(F.get(F.array(*map(F.lit, self.weights[:4])), rating - 1), F.lit(LEAST_STABILITY))

    def _difficulty(self, rating: Column) -> Column:
        return self.weights[4] - F.exp(self.weights[5] * (rating - 1)) + 1

    @staticmethod
    def _within(difficulty: Column) -> Column:
        return F.least(F.greatest(difficulty, F.lit(1.0)), F.lit(10.0))

    def first_difficulty(self, rating: Column) -> Column:
        return self._within(self._difficulty(rating))

    def next_difficulty(self, difficulty: Column, rating: Column) -> Column:
        w = self.weights
        moved = difficulty + (10 - difficulty) * (-w[6] * (rating - 3)) / 9
        return self._within(w[7] * self._difficulty(F.lit(EASY)) + (1 - w[7]) * moved)

    def next_stability(self, stability: Column, difficulty: Column, days: Column, rating: Column) -> Column:
        """days since the last review; on the same day a shorter rule holds."""
        w, r = self.weights, self.retrievability(stability, days)
        grown = F.exp(w[17] * (rating - 3 + w[18])) * F.pow(stability, F.lit(-w[19]))
        same_day = stability * F.when(rating >= GOOD, F.greatest(grown, F.lit(1.0))).otherwise(grown)
        lost = w[11] * F.pow(difficulty, F.lit(-w[12])) * (F.pow(stability + 1, F.lit(w[13])) - 1) * F.exp((1 - r) * w[14])
        forgot = F.least(lost, stability / F.exp(F.lit(w[17] * w[18])))
        weight = F.when(rating == HARD, w[15]).when(rating == EASY, w[16]).otherwise(1.0)
        recalled = stability * (1 + F.exp(F.lit(w[8])) * (11 - difficulty) * F.pow(stability, F.lit(-w[9])) * (F.exp((1 - r) * w[10]) - 1) * weight)
        return F.greatest(F.when(days < 1, same_day).when(rating == AGAIN, forgot).otherwise(recalled), F.lit(LEAST_STABILITY))

    def review(self, card: Column, rating: Column, at: Column) -> Column:
        """The card after a review. card: state (0 new, 1 learning, 2 review, 3 relearning), step, stability, difficulty, last and due (seconds); at: seconds."""
        new = card["state"] == 0
        days = F.floor((at - card["last"]) / DAY)
        stability = F.when(new, self.first_stability(rating)).otherwise(self.next_stability(card["stability"], card["difficulty"], days, rating))
        difficulty = F.when(new, self.first_difficulty(rating)).otherwise(self.next_difficulty(card["difficulty"], rating))
        wait = (self.days(stability) * DAY).cast("long")
        struct = lambda state, step, interval: F.struct(F.lit(state).alias("state"), step.cast("int").alias("step"), interval.cast("long").alias("wait"))
        none = F.lit(None)

        def through(steps: tuple[int, ...], state: int) -> Column:
            """What follows in a phase of short steps."""
            done = struct(2, none, wait)
            if not steps:
                return done
            seconds, step = F.array(*map(F.lit, steps)), card["step"]
            hard = F.when(step == 0, F.lit(steps[0] * 1.5 if len(steps) == 1 else (steps[0] + steps[1]) / 2)).otherwise(F.get(seconds, step))
            return (
                F.when(rating == AGAIN, struct(state, F.lit(0), F.lit(steps[0])))
                .when((rating == EASY) | (step >= len(steps)) | ((rating == GOOD) & (step + 1 == len(steps))), done)
                .when(rating == HARD, struct(state, step, hard))
                .otherwise(struct(state, step + 1, F.get(seconds, step + 1)))
            )

        known = F.when(rating == AGAIN, struct(3, F.lit(0), F.lit(self.relearning[0]))).otherwise(struct(2, none, wait)) if self.relearning else struct(2, none, wait)
        move = F.when(card["state"] == 2, known).when(card["state"] == 3, through(self.relearning, 3)).otherwise(through(self.learning, 1))
        return F.struct(move["state"].alias("state"), move["step"].alias("step"), stability.alias("stability"), difficulty.alias("difficulty"), at.alias("last"), (at + move["wait"]).alias("due"))


def scheduled(reviews: DataFrame, key: str, scheduler: Scheduler | None = None) -> DataFrame:
    """key, reviews, state, step, stability, difficulty, last, due: each card after its reviews, in order of at, then n.

    reviews: key, at (seconds), n, rating (1 to 4). A card's reviews are folded one after the other, in one array.
    """
    scheduler = scheduler or Scheduler()
    null = lambda kind: F.lit(None).cast(kind)
    new = F.struct(F.lit(0).alias("state"), F.nullif(F.lit(0), F.lit(-1)).alias("step"), null("double").alias("stability"), null("double").alias("difficulty"), null("long").alias("last"), null("long").alias("due"))
    rows = reviews.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("at").cast("long").alias("at"), "n", F.col("rating").cast("int").alias("rating")))).alias("r"))
    return rows.select(key, F.size("r").alias("reviews"), F.aggregate("r", new, lambda card, r: scheduler.review(card, r["rating"], r["at"])).alias("c")).select(key, "reviews", "c.*")
