"""Documents that share most of their word shingles, verified inside groups of candidates.

Candidates come as groups that only have to be large enough: any two documents that could link are in one. Inside a group
links are exact, by the Jaccard similarity of the sets of shingle hashes (64 bits). A task compares the documents of a block
and gives out edges that connect what is linked among them, so that links needn't be transitive: a document is compared with
all that are not reached yet, whether or not it links to the first one.

Candidates by shared_bands() are documents whose sets have the same smallest hashes by all ROWS functions of one of BANDS bands.
Of pairs with similarity s, (1 - s^ROWS)^BANDS are missed: 0.2 % at 0.8, 0.01 % at 0.85. A band's key is as rare as a near copy,
so no key has to be short, however large the corpus.

Groups of over BLOCK_ROWS documents or BLOCK_CHARS are dealt to blocks, each with the group's first document added. Most
groups that large are copies of one text and are then connected. Documents that aren't, meet every block of their group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import mix, running, runs, words
from .shared import blocks, saved, utf8

BLOCK_ROWS, BLOCK_CHARS = 256, 4 << 20
BANDS, ROWS = 20, 6
_random = np.random.default_rng(17)
_FLIPS, _FACTORS = (_random.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
#: Large groups that tasks may hold; with more of them the join with them shuffles.
BROADCAST_ROWS = 100_000


def shingle_hashes(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of texts that lie end to end in data, and the number of them before each text.

    A text of fewer words than `size` has one shingle, all of it; one without words has none.
    """
    _, _, tokens, cuts = words(data, at, lower=True)
    n = np.diff(cuts)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    own = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    first = cuts[text] + np.arange(own[-1]) - own[text]
    last = np.minimum(first + size, cuts[1:][text])
    return mix(runs(running(tokens), first, last) + (last - first).astype(np.uint64)), own


def band_keys(hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each text, all of which have shingles. hashes, own: as shingle_hashes() gives them."""
    keys = np.empty((len(own) - 1, BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(own) - 1, band, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key + np.minimum.reduceat((hashes ^ _FLIPS[k]) * _FACTORS[k], own[:-1]))
        keys[:, band] = key
    return keys


def shared_bands(docs: DataFrame, size: int) -> DataFrame:
    """a, b (doc_id): edges that connect documents which share a band, each to the smallest of its key."""

    def read(batches):
        for b in batches:
            data, at = utf8(b.column("text"))
            for i, j in blocks(at):
                hashes, own = shingle_hashes(data[at[i] : at[j]], at[i : j + 1] - at[i], size)
                there = np.flatnonzero(np.diff(own))
                if len(there):
                    keys = band_keys(hashes, np.append(own[there], own[-1]))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i).take(pa.array(there)), lists], names=["doc_id", "keys"])

    rows = saved(docs.select("doc_id", "text").mapInArrow(read, "doc_id long, keys array<long>"), "bands").select("doc_id", F.explode("keys").alias("key"))
    keys = saved(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("n > 1"), "keys")
    more = rows.join(keys.where("n > 2").select("key", "a"), "key").select("a", F.col("doc_id").alias("b"))
    return keys.where("n = 2").select("a", "b").unionByName(more).where("a != b").distinct()


def linked(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges that connect all sets which reach each other over pairs that share at least `least` of their members."""
    sizes = np.array([len(s) for s in sets])
    _, codes, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own, shared = np.repeat(np.arange(len(sets)), sizes), often[codes] > 1
    codes, own = codes[shared], own[shared]
    cuts, everything = np.searchsorted(own, np.arange(len(sets) + 1)), codes
    mark, open_, out = np.zeros(len(often), bool), np.ones(len(sets), bool), []
    for start in range(len(sets)):
        if not open_[start]:
            continue
        open_[start], front = False, [start]
        while front and open_.any():
            f = front.pop()
            mine = everything[cuts[f] : cuts[f + 1]]
            mark[mine] = True
            both = np.bincount(own[mark[codes]], minlength=len(sets))
            mark[mine] = False
            hit = np.flatnonzero(open_ & (both >= least * (sizes + sizes[f] - both))).tolist()
            if hit:
                out += [(f, h) for h in hit]
                front += hit
                open_[hit] = False
                still = open_[own]
                codes, own = codes[still], own[still]
    return out


def _link(size: int, least: float):
    def of(part: pa.Table) -> pa.Table:
        part = part.sort_by("doc_id")
        ids = part.column("doc_id").to_numpy()
        sets = []
        for k in range(part.num_rows):
            data, at = utf8(part.column("text").slice(k, 1))
            sets.append(np.unique(shingle_hashes(data[at[0] : at[-1]], at - at[0], size)[0]))
        edges = [(ids[x], ids[y]) for x, y in linked(sets, least) if ids[x] != ids[y]]
        a, b = zip(*edges, strict=True) if edges else ((), ())
        return pa.table({"group": pa.array([part.column("group")[0].as_py()] * len(a), pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return of


def _blocks(rows: int, chars: int):
    return F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum(F.octet_length("text")) / chars)).cast("int")


def similar(docs: DataFrame, groups: DataFrame, size: int, least: float, rows: int = BLOCK_ROWS, chars: int = BLOCK_CHARS) -> DataFrame:
    """a, b (doc_id): edges that connect the documents of each group which links hold together.

    groups: doc_id, group, which is the smallest doc_id in it. Documents link if they share at least `least` of their shingles.
    """
    link, schema = _link(size, least), "group long, a long, b long"
    few = lambda t: F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    members = saved(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(groups, "doc_id").select("group", "doc_id", "text"), "members")
    large = saved(members.groupBy("group").agg(_blocks(rows, chars).alias("n")).where("n > 1"), "large")
    large = few(large)
    block = lambda n, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = members.join(large, "group", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    place = F.when(F.col("doc_id") == F.col("group"), every("n")).otherwise(F.array(block("n", 1)))
    edges = saved(dealt.withColumn("x", F.explode(place)).select("group", "x", "doc_id", "text").groupBy("group", "x").applyInArrow(link, schema), "edges")
    if large.isEmpty():
        return edges.select("a", "b")
    reached = components(edges.join(large, "group", "left_semi")).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "group")
    spread = dealt.where("n > 1")
    rest = saved(spread.where("doc_id != group").join(reached, ["doc_id", "group"], "left_anti"), "rest")
    many = few(saved(rest.groupBy("group").agg(_blocks(rows, chars).alias("m")), "many"))
    sides = [
        spread.join(many, "group").select("group", block("n", 1).alias("x"), F.explode(every("m")).alias("y"), "doc_id", "text"),
        rest.join(many, "group").select("group", F.explode(every("n")).alias("x"), block("m", 2).alias("y"), "doc_id", "text"),
    ]
    more = sides[0].unionByName(sides[1]).groupBy("group", "x", "y").applyInArrow(link, schema)
    return edges.unionByName(saved(more, "edges")).select("a", "b")
