"""SimHash near-dedup by deletion-variant signatures.

A fingerprint has 64 bits: bit i is 1 if over half of the document's shingle hashes have it. Two fingerprints link at
`distance` or fewer differing bits. The bits are cut into distance // 2 + 1 segments, so two linked fingerprints have a segment
in which they differ by at most one bit. Each segment is indexed once for each of its bits, with that bit left out; linked
fingerprints meet under at least one of these keys by equality, and are verified.

Only distinct fingerprints take part. A key that two fingerprints share gives its pair straight from the aggregate that
counts it. Keys with more go to one task each, as long as they have no more than `bucket` fingerprints; there distances are
worked out in blocks and only the edges of a spanning forest are given out. Fingerprints under larger keys link exactly
through their variants with two bits left out: equal variants mean two or fewer differing bits, so each joins the smallest
of its class (for other distances, the block join of split buckets).

Defined results: words are runs of bytes other than ASCII white space, lower-cased A-Z; a text of fewer words than a shingle
has one shingle, all of it; a text without words (or null) has fingerprint zero, which links like any other. Of rows with one
doc_id each counts by itself. A null doc_id links like others but is never a component's smallest, unless there is no other. Other
columns are ignored; no rows give none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .hashing import BASE, mix
from .phrases import bit_map, bits_for, in_map
from .shared import blocks, free_name, saved, table, utf8
from .similar import shared_bands, similar

SEED = 42
#: Fingerprints under one key that a task compares.
BUCKET = 4096
#: Fingerprints whose variants one task gives out.
SPREAD = 50_000


def shingles(text: bytes, size: int) -> list[bytes]:
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: len(words) - size]]).tolist()
    return [joined[a : z - 1] for a, z in zip(starts, ends[size - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, size: int) -> int:
    """As a signed 64-bit number."""
    from xxhash import xxh64_intdigest

    parts = shingles(text, size)
    if not parts:
        return 0
    hashes = np.array([xxh64_intdigest(s, SEED) for s in parts], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (signed 64 bits)."""

    def of(batches):
        for b in batches:
            data, at = utf8(b.column("text"))
            for i, j in blocks(at):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array([fingerprint(data[at[k] : at[k + 1]].tobytes(), size) for k in range(i, j)], pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """First bit and number of bits of each segment."""
    n = distance // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, z - a) for a, z in zip(cuts, cuts[1:], strict=False)]


def variants(fps: DataFrame, distance: int, wanted=None) -> DataFrame:
    """fp, and a key for each segment and bit left out in it. wanted: a broadcast map of the keys that are asked for."""

    def of(batches):
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for first, n in segments(distance):
                segment = ((1 << n) - 1) << first
                for bit in range(first, first + n):
                    key = mix((fp & np.uint64(segment & ~(1 << bit))) ^ np.uint64((bit + 1) * BASE % 2**64))
                    m = in_map(wanted.value, key) if wanted else np.ones(len(fp), bool)
                    if m.any():
                        yield pa.RecordBatch.from_arrays([pa.array(fp[m].view(np.int64)), pa.array(key[m].view(np.int64))], names=["fp", "key"])

    return fps.select("fp").mapInArrow(of, "fp long, key long")


def near(a, b, distance: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked among these fingerprints, not all links: each is compared once with those not reached yet."""
    v = np.sort(fps).view(np.uint64)
    left, right, rest = [], [], v
    while len(rest):  # breadth first
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            by, hit = np.zeros(len(rest), np.uint64), np.zeros(len(rest), bool)
            for f in front:
                new = ~hit & (np.bitwise_count(rest ^ f) <= distance)
                by[new] = f
                hit |= new
            left.append(by[hit])
            right.append(rest[hit])
            front, rest = rest[hit], rest[~hit]
    none = np.zeros(0, np.int64)
    return (np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)) if left else (none, none)


def _forests(distance: int):
    """For rows of key and fp that come sorted by key."""

    def link(batches):
        carry = None
        for b in (*batches, None):
            if b is not None:
                key, fp = b.column("key").to_numpy(), b.column("fp").to_numpy()
                if carry is not None:
                    key, fp = np.concatenate([carry[0], key]), np.concatenate([carry[1], fp])
                last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if len(key) and (key != key[-1]).any() else 0
                carry = key[last:], fp[last:]
                key, fp = key[:last], fp[:last]
            elif carry is None:
                return
            else:
                key, fp = carry
            if not len(key):
                continue
            left, right = [], []
            cuts = np.flatnonzero(np.diff(key)) + 1
            for group in np.split(fp, cuts):
                if len(group) > 12:
                    x, y = forest(group, distance)
                    left += x.tolist()
                    right += y.tolist()
                else:
                    group = group.tolist()
                    for k, x in enumerate(group):
                        near = [y for y in group[k + 1 :] if ((x ^ y) & (2**64 - 1)).bit_count() <= distance]
                        left += [x] * len(near)
                        right += near
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return link


def links(fps: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """fps: distinct fp. Returns edges (a, b) between fingerprints at `distance` or less, enough of them to connect all that are linked."""
    spread = max(fps.sparkSession.sparkContext.defaultParallelism, fps.count() // SPREAD)
    fps = fps.select("fp").repartition(spread)  # each row becomes some 64
    keys = variants(fps, distance).groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    keys = saved(keys, "keys")
    pairs = keys.where("n = 2").where(near("a", "b", distance)).select("a", "b")
    many = keys.where("n > 2").select("key", "n")
    wanted = fps.sparkSession.sparkContext.broadcast(bit_map(many, "key", bits_for(many.count())))
    rows = saved(variants(fps, distance, wanted).join(many, "key"), "rows")
    few = rows.where(F.col("n") <= bucket).select("key", "fp").repartition("key").sortWithinPartitions("key")
    # written before the hot ones are looked at, so that no task holds both at once
    out = saved(pairs.unionByName(few.mapInArrow(_forests(distance), "a long, b long")), "edges")
    hot = saved(rows.where(F.col("n") > bucket).select("fp").distinct(), "hot")
    if not hot.isEmpty():
        out = out.unionByName(_two_left_out(hot) if distance == 2 else _in_blocks(hot, distance, bucket))
    return out.distinct()


def _two_left_out(fps: DataFrame) -> DataFrame:
    """Edges of classes that are equal but for two bits, each to the smallest of its class. For fingerprints under very common keys."""
    bits = [(i, j) for i in range(64) for j in range(i + 1, 64)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    masks = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(signed(~((1 << i) | (1 << j)) & (2**64 - 1))).alias("mask")) for n, (i, j) in enumerate(bits)])
    spread = max(fps.sparkSession.sparkContext.defaultParallelism, fps.count() * 64 // SPREAD)
    rows = fps.repartition(spread).select("fp", F.explode(masks).alias("m")).select("fp", F.col("m.n").alias("n"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("rest"))
    # nearly every row has a key of its own, so counting in tasks before the shuffle would only take memory
    ordered = rows.repartition("n", "rest").sortWithinPartitions("n", "rest", "fp")

    def stars(batches):
        last = None
        for b in (b for b in batches if b.num_rows):
            n, rest, fp = (b.column(c).to_numpy() for c in ("n", "rest", "fp"))
            first = np.append(True, (n[1:] != n[:-1]) | (rest[1:] != rest[:-1]))
            low = fp[np.flatnonzero(first)[np.cumsum(first) - 1]]
            if last is not None and (n[0], rest[0]) == last[:2]:
                low[: int(np.append(np.flatnonzero(first)[1:], len(fp))[0])] = last[2]
            last = n[-1], rest[-1], low[-1]
            edges = np.unique(np.stack([low[low != fp], fp[low != fp]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], names=["a", "b"])

    return ordered.mapInArrow(stars, "a long, b long").distinct()


def _in_blocks(fps: DataFrame, distance: int, bucket: int) -> DataFrame:
    """Every hot fingerprint against all hot ones, in pairs of blocks of at most `bucket`."""
    n = max(1, -(-fps.count() // (bucket // 2)))
    dealt = fps.select("fp", F.pmod(F.xxhash64("fp"), F.lit(n)).alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    meet = dealt.select("fp", "block", other.alias("other")).select("fp", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")).distinct()

    def link(part: pd.DataFrame) -> pd.DataFrame:
        a, b = forest(part["fp"].to_numpy(), distance)
        return pd.DataFrame({"a": a, "b": b})

    return meet.groupBy("x", "y").applyInPandas(link, "a long, b long")


def near_dedup(docs: DataFrame, size: int = 3, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that is reachable over links, its own included."""
    prints = saved(fingerprints(docs, size), "fingerprints")
    least = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    ends = components(links(least, distance, bucket)).withColumnRenamed("node", "fp")
    names = least.join(ends, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = names.groupBy("component").agg(F.min("least").alias("component_id"))
    names = names.join(smallest, "component").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def candidates(docs: DataFrame, size: int, distance: int, bucket: int = BUCKET) -> DataFrame:
    """a, b (doc_id): edges that connect documents whose fingerprints differ in `distance` bits or fewer, equal ones too."""
    prints = saved(fingerprints(docs, size), "fingerprints")
    least = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    a, b = (least.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")) for c in "ab")
    edges = links(least, distance, bucket).join(a, "a").join(b, "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    same = prints.join(least, "fp").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    return edges.unionByName(same).where("a != b")


def kept_documents(docs: DataFrame, size: int, distance: int, least: float, bucket: int = BUCKET) -> DataFrame:
    """The rows of docs that stay, with their columns: of each group that links hold together, the one with the smallest doc_id.

    Rows link if they share at least `least` of their distinct word shingles. Fingerprints and bands of smallest hashes
    only say which rows are compared: all those that candidate edges connect, with each other (see similar.py).

    Rows are numbered and told apart by their number, so null and repeated doc_ids don't matter; of a group's rows with the same
    doc_id the one with the smallest number stays, and null ones stay only where the group has no other. Texts without words link
    to each other. No rows give none.
    """
    row = free_name(docs, "row")
    rows = saved(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    texts = rows.select(F.col(row).alias("doc_id"), "text")
    edges = candidates(texts, size, distance, bucket).unionByName(shared_bands(texts, size))
    groups = components(saved(edges, "candidates")).select(F.col("node").alias("doc_id"), F.col("component").alias("group"))
    linked = components(similar(texts, groups, size, least))
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", F.col(row).alias("row"))
    linked = saved(linked.join(rows.select(F.col(row).alias("node"), order.alias("place")), "node"), "linked")
    stays = linked.groupBy("component").agg(F.min("place").alias("stays"))
    gone = linked.join(stays, "component").where("place.row != stays.row").select(F.col("node").alias(row))
    return rows.join(saved(gone, "gone"), row, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
