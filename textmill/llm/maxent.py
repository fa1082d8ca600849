"""Language model scoring with a hashed maximum-entropy model.

A token's probability is factored: that of its class given what stands before, times that of the token in its class, which is a
softmax too, given the same. The most frequent tokens are classes of their own. The others are classed by their last two bytes,
and in a class sorted by them; a class of many members is factored again, FAN ways at each of its levels, so a token has
a few softmaxes of a few outcomes instead of one over the vocabulary. Each softmax's logits are the outcomes' prior (their share
of the counts) plus the weights of features of the tokens before. Four choose the class: the last token, the pair of the last two, the one
before the last (a token skipped), and the pair of their classes; the first and the third of them count inside classes. Features are hashed, with the softmax's number, into rows of
weights, whose number grows with the training tokens up to a bound. One member of each class stands for its tail: there a token has its share of the tail's counts, each
plus one; one more share is for all unknown tokens of the class. So the probabilities of all tokens after any context add up to
one.

Counts cover all training tokens and stay in a table; only the head of the vocabulary, of a bounded size, goes to the tasks,
and the tail's counts come by a join. Training runs in rounds over disjoint parts of the training documents: tasks sum up
the gradient (observed less expected, by feature row and outcome) over their documents, sums meet by feature row, and the
driver takes a step scaled by the expected counts. Scoring works on blocks of documents, with numpy.

Tokens are told apart by a 64-bit hash. Defined results: a null or empty text is one end token. Rows with one doc_id are
scored one by one; a row without doc_id is scored, not learned from. With no training rows counts are zero and classes equally likely. Other columns are ignored; no rows give
none.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import mix, words
from .shared import blocks, saved, table, utf8

#: Tokens whose counts go to every task, tokens that are classes of their own, classes by ending, outcomes of a level in a class.
HEAD, OWN, CLASSES, FAN = 1 << 18, 16, 16, 16
FAN_BITS = FAN.bit_length() - 1
TOP = OWN + CLASSES
#: Rows of weights in classes: one for so many training tokens, within these powers of two. A quarter as many are for the classes.
TOKENS_A_ROW, LEAST_ROWS, MOST_ROWS = 1024, 16, 18
ROUNDS, RATE, ADDED = 3, 0.5, 4.0
#: Training tokens that a task sums the gradient over, so that what it gives out is small against what it reads.
TASK_TOKENS = 4_000_000
END, BEGIN = np.uint64(0x1234567), np.uint64(0x7654321)
#: Features that count inside classes: the last token and the one before it. All four choose the class.
FEATURES, INSIDE = 4, (0, 2)
#: Distinct tokens that a task counts before it gives them out.
HELD = 2_000_000
#: Odds are worked out for about so many bytes of text at a time, which a processor's cache holds.
STEP_BYTES = 1 << 17
#: Logs of an outcome's share and weights up to which single floats hold their powers.
LARGEST = 80
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def held_out(of: int = 7, rest: int = 2) -> Column:
    """A row without doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == rest, F.lit(True))


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows that lie end to end: each token's hash, its ending (the last two bytes, as a number), and the rows' cuts. Every row has an end token."""
    first, last, hashes, cuts = words(data, at, lower=True)
    lower = data[last - 1].astype(np.int64) | 32 if len(last) else np.zeros(0, np.int64)
    before = np.where(last - first > 1, data[np.maximum(last - 2, 0)].astype(np.int64) | 32, 0) if len(last) else lower
    # the end tokens go in after each row's words
    return np.insert(hashes, cuts[1:], END), np.insert(lower * 256 + before, cuts[1:], 0), cuts + np.arange(len(cuts))


@dataclass
class Model:
    head: np.ndarray  # hashes, ascending
    head_count: np.ndarray
    top: np.ndarray  # of each: its outcome among the classes
    member: np.ndarray  # and its number in its class
    class_of: np.ndarray  # by ending
    rare: np.ndarray  # of each class: the member that stands for its tail
    depth: np.ndarray  # and its levels
    base: np.ndarray  # and the number of each level's first softmax
    tail: np.ndarray  # and log10 of its tail's mass
    prior: list[np.ndarray]  # of the classes, and of each softmax in them: log shares
    weight: list[np.ndarray]  # (rows, outcomes) of the same

    @cached_property
    def starts(self) -> tuple[np.uint64, np.ndarray]:
        """How far to shift hashes for their first bits, and for each value of those its first place in the head; some four for each token."""
        bits = len(self.head).bit_length() + 2
        shift = np.uint64(64 - bits)
        held = np.bincount((self.head >> shift).view(np.int64), minlength=1 << bits)
        return shift, (np.cumsum(held) - held).astype(np.int32)

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens are in the head, and their places in it."""
        if not len(self.head):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        shift, starts = self.starts
        last = len(self.head) - 1
        at = np.minimum(starts.take((hashes >> shift).view(np.int64)), last).astype(np.int64)
        found = self.head.take(at)
        behind = np.flatnonzero(found < hashes)  # few: others with the same first bits lie before them
        at[behind] = np.minimum(np.searchsorted(self.head, hashes[behind]), last)
        found[behind] = self.head[at[behind]]
        return found == hashes, at

    def powered(self) -> Model:
        """The model with shares and factors in place of log shares and weights, for odds(). Single floats hold them, but after very many rounds."""
        logs = max(n * float(np.abs(w).max()) - float(p.min()) for n, w, p in zip((FEATURES, len(INSIDE)), self.weight, self.prior, strict=True))
        kind = np.float32 if logs < LARGEST else np.float64
        return replace(self, prior=[np.exp(x, dtype=kind) for x in self.prior], weight=[np.exp(x, dtype=kind) for x in self.weight])

    def places(self, inside: np.ndarray, at: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's outcome among the classes and its number in its class."""
        kind = OWN + self.class_of[ending]
        member = self.rare[kind - OWN]
        if len(self.head):
            kind, member = np.where(inside, self.top[at], kind), np.where(inside, self.member[at], member)
        return kind, member

    def softmaxes(self, context: list[np.ndarray], kind: np.ndarray, member: np.ndarray):
        """Of a block's tokens level by level: which of them have it (None: all), table, rows for each feature, priors, outcomes."""
        yield None, 0, [_row(c, self.weight[0]) for c in context], self.prior[0], kind
        classed = np.flatnonzero(kind >= OWN)
        group, number = kind.take(classed) - OWN, member.take(classed)
        depth, inside = self.depth[group], [context[c].take(classed) for c in INSIDE]
        for level in range(int(self.depth.max())):
            there = depth > level
            if not there.all():
                classed, group, number, depth, inside = classed[there], group[there], number[there], depth[there], [c[there] for c in inside]
            if not len(classed):
                return
            below = FAN_BITS * (depth - 1 - level)
            child = number >> below
            node = self.base[:, level].take(group) + (child >> FAN_BITS)
            salt = (node + 1).view(np.uint64) * _A
            yield classed, 1, [_row(c + salt, self.weight[1]) for c in inside], self.prior[1].take(node, axis=0), child & (FAN - 1)

    def odds(self, which: int, rows: list[np.ndarray], prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a powered model: each outcome's odds, and their sums. No power has to be taken, and none is too large."""
        z = self.weight[which].take(rows[0], axis=0)
        for r in rows[1:]:
            z *= self.weight[which].take(r, axis=0)
        z *= prior
        return z, z @ np.ones(z.shape[1], z.dtype)


def _row(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return ((x * _B) >> np.uint64(65 - len(weight).bit_length())).view(np.int64)


def features(hashes: np.ndarray, kind: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """What stands before each token, as hashes: the last token, the last two, the one before the last, and the classes of both."""
    place = np.arange(len(hashes)) - np.repeat(cuts[:-1], np.diff(cuts))

    def back(x: np.ndarray, n: int, begin) -> np.ndarray:
        out = np.empty_like(x)
        out[:n], out[n:] = begin, x[: len(x) - n]
        out[place < n] = begin
        return out

    one, two = back(hashes, 1, BEGIN), back(hashes, 2, BEGIN)
    pair = back(kind, 1, TOP) * (TOP + 1) + back(kind, 2, TOP)
    return [mix(one), mix(one * np.uint64(3) + mix(two)), mix(two + np.uint64(1)), mix(pair.astype(np.uint64) + np.uint64(1 << 40))]


def vocabulary(docs: DataFrame) -> DataFrame:
    """word (hash), ending, c: the count of every token of docs."""

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def together():
            w, e, n = (np.concatenate(x) for x in zip(*held, strict=True))
            w, first, inverse = np.unique(w, return_index=True, return_inverse=True)
            return w, e[first], np.bincount(inverse, weights=n).astype(np.int64)

        def out():
            w, e, n = together()
            for i in range(0, len(w), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(w[i : i + 100_000].view(np.int64)), pa.array(e[i : i + 100_000]), pa.array(n[i : i + 100_000])], names=["word", "ending", "c"])

        for b in batches:
            data, at = utf8(b.column("text"))
            for i, j in blocks(at):
                w, e, _ = tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])
                w, first, n = np.unique(w, return_index=True, return_counts=True)
                held.append((w, e[first], n))
                if len(held) >= 8:
                    held = [together()]
                    if len(held[0][0]) > HELD:
                        yield from out()
                        held = []
        if held:
            yield from out()

    return docs.select("text").mapInArrow(count, "word long, ending long, c long").groupBy("word").agg(F.first("ending").alias("ending"), F.sum("c").alias("c"))


def start(counts: DataFrame, head: int = HEAD) -> tuple[Model, int, int]:
    """The model before training, the number of training tokens and that of distinct ones."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    size = F.floor(F.log2("c") * 64)  # a few thousand sizes at most, whatever the counts
    taken, least = 0, 1 << 30
    for r in sorted(counts.groupBy(size.alias("size")).count().collect(), reverse=True):
        if taken + r["count"] > head:
            break
        taken, least = taken + r["count"], r["size"]
    rows = counts.where(size >= least).select("word", "c", "ending").toPandas()  # `head` rows at most
    word, c, ending = rows["word"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64), rows["ending"].to_numpy(np.int64)
    order = np.argsort(word)
    word, c, ending = word[order], c[order], ending[order]
    mass = np.zeros(1 << 16)
    for r in counts.groupBy("ending").agg(F.sum(F.col("c") + 1).alias("mass")).collect():  # a row for each two bytes at most
        mass[r.ending] = r.mass
    best = np.lexsort((word, -c))[:OWN]
    np.subtract.at(mass, ending[best], c[best] + 1)
    # classes of about equal mass
    class_of = np.minimum(((np.cumsum(mass) - mass) / max(mass.sum(), 1) * CLASSES).astype(np.int64), CLASSES - 1)
    top, member = OWN + class_of[ending], np.zeros(len(word), np.int64)
    top[best] = np.arange(len(best))
    others = np.flatnonzero(top >= OWN)
    others = others[np.lexsort((word[others], ending[others], top[others]))]
    group = top[others] - OWN
    members = np.bincount(group, minlength=CLASSES)
    member[others] = np.arange(len(others)) - (np.cumsum(members) - members)[group]
    tail = np.bincount(class_of, weights=mass, minlength=CLASSES) - np.bincount(group, weights=c[others] + 1, minlength=CLASSES) + 1  # one for unknown tokens
    depth = np.ones(CLASSES, np.int64)
    while (FAN**depth < members + 1).any():
        depth += FAN**depth < members + 1
    base, priors, nodes = np.zeros((CLASSES, int(depth.max())), np.int64), [], 0
    firsts = np.cumsum(members) - members
    for k in range(CLASSES):
        leaves = np.append(c[others[firsts[k] : firsts[k] + members[k]]] + 1.0, tail[k])
        for level in range(int(depth[k])):
            below = FAN ** int(depth[k] - 1 - level)
            n = -(-len(leaves) // (below * FAN))
            shares = np.add.reduceat(leaves, np.arange(0, len(leaves), below))
            shares = np.pad(shares, (0, n * FAN - len(shares))).reshape(n, FAN)
            base[k, level] = nodes
            nodes += n
            priors.append(shares / shares.sum(1, keepdims=True))
    classes = np.zeros(TOP)
    classes[: len(best)] = c[best] + 1
    classes[OWN:] = tail + np.bincount(group, weights=c[others] + 1, minlength=CLASSES)
    with np.errstate(divide="ignore"):
        prior = [np.maximum(np.log(x), -30).astype(np.float32) for x in (classes / classes.sum(), np.concatenate(priors))]
    bits = int(np.clip(np.log2(max(total, 1) / TOKENS_A_ROW), LEAST_ROWS, MOST_ROWS))
    weight = [np.zeros((1 << (bits - 2), TOP), np.float32), np.zeros((1 << bits, FAN), np.float32)]
    return Model(word, c, top, member, class_of, members, depth, base, np.log10(tail), prior, weight), int(total), int(distinct)


def _add(total: np.ndarray, rows: list[np.ndarray], values: np.ndarray) -> None:
    """Adds each of values to its row of total, for each of rows. Outcomes go two at a time, as complex numbers: numpy adds those at half as many places."""
    total = total.view(complex)
    width, step = total.shape[1], 1 << 15
    within = np.tile(np.arange(width), min(step, len(values)))
    for i in range(0, len(values), step):
        pairs = values[i : i + step].astype(float).view(complex).reshape(-1)
        for r in rows:
            places = np.repeat(r[i : i + step] * width, width)
            places += within[: len(places)]
            np.add.at(total.reshape(-1), places, pairs)


def _add_by_outcome(total: np.ndarray, rows: tuple[list[np.ndarray], ...], values: tuple[np.ndarray, ...]) -> None:
    """The same for arrays of values, each with its rows, where total is (outcomes, rows). For very many values and rows: those of one outcome fit a processor's cache, all of them don't."""
    by_outcome, at = np.empty((len(total), sum(map(len, values)))), 0
    for v in values:
        for i in range(0, len(v), 4096):
            part = v[i : i + 4096]
            by_outcome[:, at : at + len(part)] = part.T
            at += len(part)
    for r in map(np.concatenate, zip(*rows, strict=True)):
        for sums, column in zip(total, by_outcome, strict=True):
            sums += np.bincount(r, column, len(sums))


def _short(x: np.ndarray) -> np.ndarray:
    """Numbers with the upper half of their bits."""
    return ((np.ascontiguousarray(x, "<f4").view("<u4") + np.uint32(0x8000)) >> np.uint32(16)).astype("<u2")


def _long(x: np.ndarray) -> np.ndarray:
    return (x.astype("<u4") << np.uint32(16)).view("<f4")


def gradient(docs: DataFrame, model) -> DataFrame:
    """row (table and row), sums: for each row of weights the observed less the expected counts of the outcomes, and the expected ones, in short form."""

    def of(batches):
        m = model.value.powered()
        seen = [np.zeros(w.size) for w in m.weight]
        expected = [np.zeros(m.weight[0].shape)]
        inside, most = np.zeros(m.weight[1].shape[::-1]), len(m.weight[1])  # expected in classes, which many softmaxes add to
        waiting: list[tuple[list[np.ndarray], np.ndarray]] = []  # of those: rows and shares, added when there is one for each row
        cells: list[list[np.ndarray]] = [[], []]  # observed, counted now and then

        def count():
            for k in (0, 1):
                if cells[k]:
                    seen[k] += np.bincount(np.concatenate(cells[k]), minlength=seen[k].size)
                    cells[k].clear()

        def add():
            if waiting:
                _add_by_outcome(inside, *zip(*waiting, strict=True))
                waiting.clear()

        for b in batches:
            data, at = utf8(b.column("text"))
            for i, j in blocks(at, STEP_BYTES):
                hashes, ending, cuts = tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])
                kind, member = m.places(*m.known(hashes), ending)
                for _, k, rows, prior, outcome in m.softmaxes(features(hashes, kind, cuts), kind, member):
                    p, whole = m.odds(k, rows, prior)
                    p /= whole[:, None]
                    for r in rows:
                        cells[k].append((r * m.weight[k].shape[1] + outcome).astype(np.int32))
                    if not k:
                        _add(expected[0], rows, p)
                        continue
                    for n in range(0, len(p), most):
                        waiting.append(([r[n : n + most] for r in rows], p[n : n + most]))
                        if sum(len(q) for _, q in waiting) >= most:
                            add()
                if len(cells[1]) > 200:
                    count()
        count()
        add()
        expected.append(np.ascontiguousarray(inside.T))
        for k in (0, 1):
            used = np.flatnonzero(expected[k].sum(1))
            diff = seen[k].reshape(expected[k].shape)[used] - expected[k][used]
            for i in range(0, len(used), 10_000):
                sums = _short(np.concatenate([diff[i : i + 10_000], expected[k][used[i : i + 10_000]]], 1))
                yield pa.RecordBatch.from_arrays([pa.array(used[i : i + 10_000] + (k << 32)), pa.array([x.tobytes() for x in sums], pa.binary())], names=["row", "sums"])

    def meet(batches):
        shapes = [w.shape for w in model.value.weight]
        total = [np.zeros((n, 2 * w)) for n, w in shapes]
        for b in batches:
            row, sums = b.column("row").to_numpy(), np.array(b.column("sums").to_pylist(), object)
            for k in (0, 1):
                own = np.flatnonzero(row >> 32 == k)
                if len(own):
                    own = own[np.argsort(row[own], kind="stable")]
                    r = row[own] & 0xFFFFFFFF
                    first = np.flatnonzero(np.diff(r, prepend=-1))
                    total[k][r[first]] += np.add.reduceat(_long(np.frombuffer(b"".join(sums[own]), "<u2")).reshape(len(own), -1).astype(float), first, axis=0)
        for k in (0, 1):
            used = np.flatnonzero(total[k][:, shapes[k][1] :].any(1))
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(used + (k << 32)), pa.array([x.tobytes() for x in _short(total[k][used])], pa.binary())], names=["row", "sums"])

    return docs.select("text").mapInArrow(of, "row long, sums binary").repartition("row").mapInArrow(meet, "row long, sums binary")


def train(docs: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    sc = docs.sparkSession.sparkContext
    for k in range(rounds):
        given = sc.broadcast(model)
        part = docs.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(rounds)) == k)
        found = gradient(part, given).toPandas()  # a row for each row of weights at most
        row, sums = found["row"].to_numpy(np.int64), found["sums"].to_numpy()
        for which, weight in enumerate(model.weight):
            own = np.flatnonzero(row >> 32 == which)
            diff, expected = _long(np.frombuffer(b"".join(sums[own]), "<u2")).reshape(len(own), 2, weight.shape[1]).swapaxes(0, 1)
            weight[row[own] & 0xFFFFFFFF] += np.clip(RATE * diff / (expected + ADDED), -1, 1)
    return model


def scores(docs: DataFrame, model) -> DataFrame:
    """For each document a row without word: its tokens, those known from the head, the head's part of the sum of log10(c + 1), and
    the rest of the score; and for each of its tail tokens a row with word and n. row tells the documents apart."""

    def of(batches):
        from pyspark import TaskContext

        m, row = model.value.powered(), TaskContext.get().partitionId() << 33
        log_count = np.log10(m.head_count + 1.0)
        for b in batches:
            data, at = utf8(b.column("text"))
            for i, j in blocks(at, STEP_BYTES):
                hashes, ending, cuts = tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])
                inside, place = m.known(hashes)
                kind, member = m.places(inside, place, ending)
                log_p = np.zeros(len(hashes))
                for own, k, rows, prior, outcome in m.softmaxes(features(hashes, kind, cuts), kind, member):
                    z, whole = m.odds(k, rows, prior)
                    of_own = z.reshape(-1).take(np.arange(len(z)) * z.shape[1] + outcome)
                    log_p[slice(None) if own is None else own] += np.log(np.divide(of_own, whole, dtype=float))
                counted = np.zeros(len(hashes))
                counted[inside] = log_count[place[inside]]
                given = np.where(inside, -counted, -m.tail[np.maximum(kind - OWN, 0)])  # the sum has log10(c + 1) of every token
                add = lambda x, first=cuts[:-1]: np.add.reduceat(x, first)
                ids, n = np.arange(row, row + j - i), j - i
                row += n
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), b.column("doc_id").slice(i, n), none, pa.array(np.diff(cuts)), pa.array(add(inside.astype(np.int64))), pa.array(add(counted)), pa.array(add(log_p / np.log(10) + given))],
                    names=_SCORED,
                )
                tail = np.flatnonzero(~inside)
                key = np.stack([np.searchsorted(cuts, tail, "right") - 1, hashes[tail].view(np.int64)])
                if len(tail):
                    order = np.lexsort(key)
                    key = key[:, order]
                    first = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
                    nulls = pa.nulls(len(first), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[key[0, first]]), pa.nulls(len(first), pa.int64()), pa.array(key[1, first]), pa.array(np.diff(np.append(first, len(tail)))), pa.nulls(len(first), pa.int64()), nulls, nulls], names=_SCORED)

    return docs.select("doc_id", "text").mapInArrow(of, "row long, doc_id long, word long, n long, n_head long, counted double, rest double")


_SCORED = ["row", "doc_id", "word", "n", "n_head", "counted", "rest"]


def score(docs: DataFrame, training: Column, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score. training: which rows to learn from."""
    known = docs.where(training).select("doc_id", "text")
    counts = saved(vocabulary(known), "counts")
    model, total, distinct = start(counts, head)
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast(train(known.coalesce(max(2 * sc.defaultParallelism, total // TASK_TOKENS)), model, rounds))
    parts = saved(scores(docs, model), "scores")
    tail = parts.where("word is not null").select("row", "word", "n").join(counts.select("word", "c"), "word", "left")
    tail = tail.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1))).alias("tail"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_tail"))
    rows = parts.where("word is null").join(tail, "row", "left").withColumn("sum", F.col("counted") + F.coalesce("tail", F.lit(0.0)))
    return rows.select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("sum") - F.col("n") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("sum") + F.col("rest")).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, ~held_out()).withColumn("held_out", held_out())
