"""Benchmark decontamination by spaced seeds.

Texts are lower-cased and cut into tokens (runs of letters, digits and bytes outside ASCII). A mask says which of the tokens
in a short stretch count: substituted tokens at its other places leave the hash as it is. The hashes of all stretches of
the benchmark and of the documents are joined by equality. A hit gives a diagonal, the shift between document and item; along
it the longest well-matching overlap is worked out token by token, and counts if at least `identity` of its tokens match and
it has `overlap` tokens, or that share of an item with fewer.

The masks miss nothing: any stretch of 7 tokens or more of which 80 % match is hit by one of MASKS (test_masks_hit_every_overlap
works it out), and any of 4 to 6 by one of SHORT_MASKS, which are for items of fewer than 8 tokens.

The benchmark is a query set. It goes to the tasks in parts of PART_TOKENS tokens at most, as sorted hashes with their places; the
documents are read once for each part, and the join is made where they are read, so neither texts nor hits are shuffled. All
diagonals of a document and an item are verified together, in pieces of a bounded size.

Defined results: null and empty texts match nothing, nor do items of fewer than `least` tokens. Rows of one doc_id, or of one
item_id, null ones too, are searched one by one; overlaps() gives one row for each pair of ids, the best one, and clean_documents()
decides on each row by its own text. Other columns are ignored; no rows give none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import mix, words
from .shared import blocks, free_name, saved, table, utf8

#: 1: the token counts. Five tokens of five to nine; for short items four of four or five.
MASKS = ("1101011", "11001011", "110010101", "11111", "111011")
SHORT_MASKS = ("1111", "10111", "11011", "11101")
SHORT = 8
OVERLAP, IDENTITY, LEAST = 13, 0.8, 5
#: Tokens of the benchmark that tasks hold at a time (some 100 bytes each).
PART_TOKENS = 1 << 20
#: Hits that are worked on at a time, and tokens compared.
HITS, CELLS = 1 << 18, 1 << 22
#: Of a document's token hashes, the low bits that find out whether the benchmark has one like it.
BITS = 22

SEPARATORS = np.ones(256, bool)
SEPARATORS[128:] = False
for _a, _z in ("az", "AZ", "09"):
    SEPARATORS[ord(_a) : ord(_z) + 1] = False
_FACTORS = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The hash of every stretch of the mask's length."""
    n = max(0, len(tokens) - len(mask) + 1)
    total = np.full(n, int(mask, 2) + (len(mask) << 32), np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            total += tokens[j : j + n] * _FACTORS[j]
    return mix(total)


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, _, hashes, cuts = words(data, at, lower=True, separators=SEPARATORS)
    return hashes, cuts


@dataclass
class Items:
    """A part of the benchmark. Items lie end to end in tokens; seed[i] stands at at[i], ascending by seed."""

    ids: list
    tokens: np.ndarray
    cuts: np.ndarray
    masks: list[str]
    seed: np.ndarray
    at: np.ndarray
    there: np.ndarray  # which low bits some seed has

    @classmethod
    def of(cls, ids: list, lists: list[np.ndarray], masks) -> Items:
        flat, cuts = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        size = np.diff(cuts)
        owner = np.repeat(np.arange(len(size)), size)
        masks = [*masks, *(SHORT_MASKS if (size < SHORT).any() else ())]
        seed, at = [], []
        for mask in masks:
            s = seeds(flat, mask)
            i = np.arange(len(s))
            inside = owner[i] == owner[i + len(mask) - 1]
            if mask in SHORT_MASKS:
                inside &= size[owner[i]] < SHORT
            seed.append(s[inside])
            at.append(i[inside])
        seed, at = np.concatenate(seed), np.concatenate(at)
        order = np.argsort(seed, kind="stable")
        there = np.zeros(1 << BITS, bool)
        there[seed & np.uint64((1 << BITS) - 1)] = True
        return cls(ids, flat, cuts, masks, seed[order], at[order], there)

    def touched(self, values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Numbers of the texts that lie end to end in values which have a seed of the benchmark, or seem to at a border."""
        out = np.zeros(len(cuts) - 1, bool)
        for mask in self.masks:
            s = seeds(values, mask)
            place = np.flatnonzero(self.there[s & np.uint64((1 << BITS) - 1)])
            at = np.minimum(np.searchsorted(self.seed, s[place]), len(self.seed) - 1)
            place = place[self.seed[at] == s[place]] if len(self.seed) else place[:0]
            out[np.searchsorted(cuts, place, "right") - 1] = True
        return np.flatnonzero(out)

    def hits(self, doc: np.ndarray):
        """Places in the document and in the items' tokens of equal seeds, in pieces of HITS or so."""
        for mask in self.masks:
            s = seeds(doc, mask)
            place = np.flatnonzero(self.there[s & np.uint64((1 << BITS) - 1)])
            first = np.searchsorted(self.seed, s[place], "left")
            n = np.searchsorted(self.seed, s[place], "right") - first
            place, first, n = place[n > 0], first[n > 0], n[n > 0]
            ends = np.cumsum(n)
            i = 0
            while i < len(n):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + HITS, "right")))
                own = n[i:j]
                step = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
                yield np.repeat(place[i:j], own), self.at[np.repeat(first[i:j], own) + step]
                i = j

    def best(self, doc: np.ndarray, identity: float, overlap: int) -> dict[int, tuple]:
        """For each item with an overlap, its number and (matches, length, doc_start, item_start) of the best one."""
        out: dict[int, tuple] = {}
        done = np.zeros(0, np.int64)  # diagonals seen, as item and shift
        span = len(doc) + len(self.tokens) + 1
        for place, at in self.hits(doc):
            item = np.searchsorted(self.cuts, at, "right") - 1
            diagonal = np.unique(item * span + place - (at - self.cuts[item]) + len(self.tokens))
            diagonal = diagonal[~np.isin(diagonal, done)]
            done = np.union1d(done, diagonal)
            item, shift = diagonal // span, diagonal % span - len(self.tokens)
            for k in np.unique(item).tolist():
                own = self.tokens[self.cuts[k] : self.cuts[k + 1]]
                need = min(overlap, math.ceil(identity * len(own)))
                shifts = shift[item == k]
                step = max(1, CELLS // len(own))
                for i in range(0, len(shifts), step):
                    for found in _overlaps(doc, own, shifts[i : i + step], identity, need):
                        if k not in out or _rank(found) > _rank(out[k]):
                            out[k] = found
        return out


def _rank(found: tuple) -> tuple:
    matches, length, doc_start, item_start = found
    return matches, -length, -doc_start, -item_start


def _overlaps(doc: np.ndarray, item: np.ndarray, shifts: np.ndarray, identity: float, need: int):
    """(matches, length, doc_start, item_start) of the best overlap with at least `need` tokens along these diagonals, if there is one."""
    at = shifts[:, None] + np.arange(len(item))
    inside = (at >= 0) & (at < len(doc))
    same = (doc[np.clip(at, 0, len(doc) - 1)] == item) & inside
    share = Fraction(identity).limit_denominator(1000)
    likely = np.flatnonzero(same.sum(1) * share.denominator >= need * share.numerator)
    if not len(likely):
        return
    # of diagonals that match alike, as in repetitive texts, the first one counts
    pattern = np.packbits(np.concatenate([same[likely], inside[likely]], 1), axis=1)
    _, first_like = np.unique(pattern.view(f"V{pattern.shape[1]}"), return_index=True)
    found = []
    for i in likely[np.sort(first_like)].tolist():
        first, last = int(inside[i].argmax()), int(inside[i].sum() + inside[i].argmax())
        a, z = best_overlap(same[i, first:last], identity)
        if z - a >= need:
            found.append((int(same[i, first + a : first + z].sum()), z - a, int(shifts[i]) + first + a, first + a))
            if found[-1][0] == len(item):  # all of it: no other is better
                break
    if found:
        yield max(found, key=_rank)


def best_overlap(same: np.ndarray, identity: float) -> tuple[int, int]:
    """First and last + 1 of the longest stretch of which at least `identity` match; the first of equal ones.

    A match gains and a mismatch loses whole numbers, so that a stretch [a, z) is one if gain[z] >= gain[a].
    """
    share = Fraction(identity).limit_denominator(1000)
    gain = np.concatenate([[0], np.cumsum(np.where(same, share.denominator - share.numerator, -share.numerator))])
    best_after = np.maximum.accumulate(gain[::-1])[::-1]
    end = np.searchsorted(-best_after, -gain, "right") - 1  # the last place with as much gain as each
    start = int((end - np.arange(len(gain))).argmax())
    return start, int(end[start])


def parts(benchmark: DataFrame, masks, least: int, part_tokens: int):
    """The benchmark's items in parts. Each row of the query set passes the driver once, a part at a time."""

    def read(batches):
        for b in batches:
            data, at = utf8(b.column("text"))
            hashes, cuts = tokens(data[at[0] : at[-1]], at - at[0])
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(hashes.view(np.int64)))], names=["item_id", "tokens"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).mapInArrow(read, "item_id long, tokens array<long>")
    rows = saved(rows.where(F.size("tokens") >= least).distinct(), "items")
    ids, lists, held = [], [], 0
    for r in rows.toLocalIterator():
        ids.append(r.item_id)
        lists.append(np.array(r.tokens, np.int64).view(np.uint64))
        held += len(lists[-1])
        if held >= part_tokens:
            yield Items.of(ids, lists, masks)
            ids, lists, held = [], [], 0
    if ids:
        yield Items.of(ids, lists, masks)


def _rows(b: pa.RecordBatch, lowered: str, items: Items):
    """Number and tokens of each row that has a seed of the benchmark."""
    data, at = utf8(b.column(lowered))
    for i, j in blocks(at):
        values, cuts = tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])
        for k in items.touched(values, cuts).tolist():
            yield i + k, values[cuts[k] : cuts[k + 1]]


def overlaps(docs: DataFrame, benchmark: DataFrame, masks=MASKS, overlap: int = OVERLAP, identity: float = IDENTITY, least: int = LEAST, part_tokens: int = PART_TOKENS) -> DataFrame:
    """doc_id, item_id, matches, length, doc_start, item_start, item_tokens: the best overlap of each pair that has one."""
    schema = "doc_id long, item_id long, matches long, length long, doc_start long, item_start long, item_tokens long"
    rows, found = docs.select("doc_id", F.lower("text").alias("text")), docs.sparkSession.createDataFrame([], schema)
    for items in parts(benchmark, masks, least, part_tokens):
        given = docs.sparkSession.sparkContext.broadcast(items)

        def search(batches, given=given):
            names = [c.split()[0] for c in schema.split(", ")]
            for b in batches:
                items, ids = given.value, b.column("doc_id")
                out = [(k, item, best) for k, doc in _rows(b, "text", items) for item, best in items.best(doc, identity, overlap).items()]
                if out:
                    columns = [pa.array([best[c] for _, _, best in out], pa.int64()) for c in range(4)]
                    size = pa.array([int(items.cuts[item + 1] - items.cuts[item]) for _, item, _ in out], pa.int64())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([k for k, _, _ in out])), pa.array([items.ids[item] for _, item, _ in out], pa.int64()), *columns, size], names=names)

        found = found.unionByName(saved(rows.mapInArrow(search, schema), "overlaps"))
    best = F.max_by(F.struct("matches", "length", "doc_start", "item_start", "item_tokens"), F.struct("matches", -F.col("length"), -F.col("doc_start"), -F.col("item_start")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame, masks=MASKS, overlap: int = OVERLAP, identity: float = IDENTITY, least: int = LEAST, part_tokens: int = PART_TOKENS) -> DataFrame:
    """The rows of docs that overlap no item. Each row is decided on where it is read, so null and repeated ids don't matter."""
    lowered = free_name(docs, "lowered")
    out = docs.withColumn(lowered, F.lower("text"))
    for items in parts(benchmark, masks, least, part_tokens):
        given = docs.sparkSession.sparkContext.broadcast(items)

        def clean(batches, given=given):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for k, doc in _rows(b, lowered, given.value):
                    keep[k] = not given.value.best(doc, identity, overlap)
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(clean, out.schema)
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
