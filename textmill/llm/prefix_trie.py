r"""A trie of the prefixes that conversations share.

A node is a distinct sequence of the first d turns (role, text) of some conversations, its members; the root is the empty sequence, of all.

Turns are numbered by scans in order, which also sum polynomials of the turns' hashes, so each prefix has a fingerprint (numpy; a
long conversation lies in several tasks). Rows of one depth and fingerprint are candidates for one node; they are grouped by what they end in:
the fingerprint of the prefix before, role and text, byte by byte. Where every candidate agrees with its group's representative (the smallest
member) in these, all of them do in every turn, by induction over the depth: nodes are verified turn by turn, though no
prefix is held as a whole. If a group disagrees, it is split: all prefixes get another, independent fingerprint besides, and are grouped and verified again.

Roll-up: a node belongs to its smallest member, whose nodes make up a path from some depth down; paths hang at nodes of others. Totals of paths go up
to the paths that they hang at by doubling (twice as far each round, so rounds grow with the logarithm of how deep paths hang); inside a
path they are sums from below. So neither long conversations nor deep tries need a round for each level.

Members that end at a node are listed in a stream sorted by conv_id, in pieces of bounded size.

Defined results: rows are in order of turn (null first), then role, then text; null role and text are empty; equal rows all count. Rows without conv_id belong to
no conversation and are left out. No rows give no nodes, not even the root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import BASE
from .ordered import running
from .shared import saved, table

#: Turns at most that a conversation takes over, and the number of conversations with one source, in rebuilt().
MOST, EVERY = 3, 20
WORD = r"[^\x20\x09-\x0D]+"
#: Ids in a piece of a list of members.
LISTED = 4096
#: A lookup's key is hot if it has more rows than this, and than a 100,000th of all: so hot keys are 100,000 at most.
HOT, MOST_HOT = 256, 100_000


def _power(base: int, n: np.ndarray) -> np.ndarray:
    """base^n modulo 2^64; n may be negative (base is odd)."""
    out, at = np.ones(len(n), np.uint64), np.abs(n)
    up, down = base, pow(base, -1, 1 << 64)
    while at.any():
        odd = (at & 1).astype(bool)
        out[odd] *= np.where(n[odd] < 0, np.uint64(down), np.uint64(up))
        up, down, at = up * up % (1 << 64), down * down % (1 << 64), at >> 1
    return out


def _base(k: int) -> int:
    return (BASE + 0x5851F42D4C957F2D * 2 * k) % (1 << 64)


def turn_hash(k: int) -> Column:
    return F.xxhash64(F.lit(k), "role", "text")


def numbered(conversations: DataFrame, prints: int) -> DataFrame:
    """conv_id, role, text, n (from 1), and for each fingerprint k the turn's hash t{k} and the polynomial t{k}_to of the turns up to it."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", *(turn_hash(k).alias(f"t{k}") for k in range(prints)))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    return running(rows, "conv_id", [*order, F.substring("text", 1, 64)], [*order, F.asc("text")], polys={f"t{k}": _base(k) for k in range(prints)}, name="turns").drop("of_first", "turn")


def rebuilt(turns: DataFrame, prints: int) -> tuple[DataFrame, DataFrame]:
    """What every conversation is made of: the first h turns of conversation conv_id - conv_id % EVERY, then its own after its first h; h = crc32(conv_id) % (MOST + 1).

    The first result has a row for each conversation: conv_id, depth (its turns), f{k} (its fingerprints). The second one has a row for each own turn that stays, and one
    for each turn taken over from a source, however many take it: depth, f{k}, q{k} (of the prefix before), role, text, members, conv_id (the smallest of them).
    """
    to, own, source = ([f"{x}{k}" for k in range(prints)] for x in ("t", "own", "source"))
    upto = F.array(*(f"{c}_to" for c in to))
    each = turns.groupBy("conv_id").agg(F.max("n").alias("len"), F.max_by(upto, "n").alias("end"), *(F.max(F.when(F.col("n") == i, upto)).alias(f"to{i}") for i in range(1, MOST + 1)))
    each = each.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST + 1)).cast("int")).withColumn("from", F.expr(f"conv_id - conv_id % {EVERY}"))
    at = lambda n, *prefix: F.coalesce(*(F.when(n == i, F.col(".".join([*prefix, f"to{i}"]))) for i in range(1, MOST + 1)), F.array(*[F.lit(0).cast("long")] * prints))
    b = each.alias("b").select(F.col("conv_id").alias("from"), F.struct("len", *(f"to{i}" for i in range(1, MOST + 1))).alias("b"))
    each = each.join(b, "from", "left").withColumn("b_len", F.least("h", F.coalesce("b.len", F.lit(0))).cast("int"))
    each = saved(
        each.select("conv_id", "len", "h", "from", F.col("b_len").alias("b"), "end", at(F.least("h", "len")).alias("own"), at(F.col("b_len"), "b").alias("source")).select(
            "conv_id", "len", "h", "from", "b", *(F.col("end")[k].alias(f"end{k}") for k in range(prints)), *(F.col("own")[k].alias(c) for k, c in enumerate(own)), *(F.col("source")[k].alias(c) for k, c in enumerate(source))
        ),
        "each",
    )

    def ends(batches):
        for x in batches:
            col = {c: x.column(c).to_numpy() for c in x.schema.names}
            u = lambda c: col[c].view(np.uint64)  # noqa: B023, E731
            more = col["len"] > col["h"]
            prints_ = [np.where(more, u(f"source{k}") + _power(_base(k), col["b"].astype(np.int64) - col["h"]) * (u(f"end{k}") - u(f"own{k}")), u(f"source{k}")).view(np.int64) for k in range(prints)]
            depth = col["b"] + np.maximum(col["len"] - col["h"], 0)
            yield pa.RecordBatch.from_arrays([x.column("conv_id"), pa.array(depth, pa.int64()), *map(pa.array, prints_)], names=["conv_id", "depth", *(f"f{k}" for k in range(prints))])

    fs = [f"f{k}" for k in range(prints)]
    whole = each.mapInArrow(ends, ", ".join(["conv_id long, depth long", *(f"{c} long" for c in fs)]))

    info = each.select("conv_id", "h", "b", *own, *source)
    parts = turns.select("part", "conv_id").distinct().join(info, "conv_id")
    # a conversation's rows are told apart by the part they lie in, so a long one meets its line in several tasks
    rows = turns.join(parts, ["part", "conv_id"]).where("n > h").select("conv_id", F.lit(1).cast("long").alias("members"), "n", "h", "b", "role", "text", *to, *(f"{c}_to" for c in to), *own, *source)
    taken = each.where("b > 0").select("conv_id", "from", F.explode(F.sequence(F.lit(1), "b")).alias("n")).groupBy("from", "n").agg(F.count("*").alias("members"), F.min("conv_id").alias("conv_id"))
    heads = turns.where(f"n <= {MOST} and conv_id % {EVERY} = 0").select(F.col("conv_id").alias("from"), "n", "role", "text", *to, *(f"{c}_to" for c in to))
    zero = [F.lit(0).cast("int").alias(c) for c in ("h", "b")] + [F.lit(0).cast("long").alias(c) for c in (*own, *source)]
    rows = rows.unionByName(heads.join(taken, ["from", "n"]).select("conv_id", "members", "n", "role", "text", *to, *(f"{c}_to" for c in to), *zero))

    def prefixes(batches):
        for x in batches:
            col = {c: x.column(c).to_numpy() for c in x.schema.names if c not in ("role", "text")}
            u = lambda c: col[c].view(np.uint64)  # noqa: B023, E731
            shift, depth, f, q = col["b"].astype(np.int64) - col["h"], col["b"] + col["n"] - col["h"], [], []
            for k in range(prints):
                f.append(u(f"source{k}") + _power(_base(k), shift) * (u(f"t{k}_to") - u(f"own{k}")))
                q.append(f[-1] - u(f"t{k}") * _power(_base(k), depth))
            arrays = [pa.array(depth, pa.int64()), *(pa.array(v.view(np.int64)) for v in [*f, *q]), x.column("role"), x.column("text"), x.column("members"), x.column("conv_id")]
            yield pa.RecordBatch.from_arrays(arrays, names=["depth", *fs, *(f"q{k}" for k in range(prints)), "role", "text", "members", "conv_id"])

    return whole, rows.mapInArrow(prefixes, ", ".join(["depth long", *(f"{c}{k} long" for c in "fq" for k in range(prints)), "role string, text string, members long, conv_id long"]))


def verified(conversations: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Every node but the root (depth, f{k}, q{k}, conv_id, n_convs, words), each conversation's end, and the number of fingerprints that it took."""
    prints = 1
    while True:
        fs, qs = ([f"{x}{k}" for k in range(prints)] for x in "fq")
        whole, rows = rebuilt(numbered(conversations, prints), prints)
        groups = rows.groupBy("depth", *fs, *qs, "role", "text").agg(F.sum("members").alias("n_convs"), F.min("conv_id").alias("conv_id"))
        nodes = saved(groups.select("depth", *fs, *qs, "conv_id", "n_convs", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")), "nodes")
        if nodes.groupBy("depth", *fs).count().where("count > 1").isEmpty():
            return nodes, saved(whole, "ends"), prints
        prints += 1


def lookup(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left, a saved table, with the columns that right, whose keys are unique, has for them (or nulls). Keys that many rows of left have go by broadcast."""
    bar = max(HOT, left.count() // MOST_HOT)
    hot = F.broadcast(saved(left.groupBy(*on).count().where(F.col("count") > bar).drop("count").join(right, on, "left"), "hot"))
    rest = left.join(hot.select(*on), on, "left_anti").join(right, on, "left")
    return left.join(hot, on).unionByName(rest)


def listed(ends: DataFrame, fs: list[str]) -> DataFrame:
    """depth, f{k}, ends_sha256: of the conversations that end at a node, in order of conv_id."""
    key = ["depth", *fs]

    def pieces(batches):
        for x in batches:
            rows, out = list(zip(*(x.column(c).to_pylist() for c in [*key, "conv_id"]), strict=True)), []
            i = 0
            while i < len(rows):
                j = i + 1
                while j < len(rows) and j - i < LISTED and rows[j][:-1] == rows[i][:-1]:
                    j += 1
                out.append((*rows[i], ",".join(str(r[-1]) for r in rows[i:j])))
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*key, "conv_id", "ids"])

    def digests(batches):
        now, digest = None, None
        for x in batches:
            out = []
            for *node, ids in zip(*(x.column(c).to_pylist() for c in [*key, "ids"]), strict=True):
                if node == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = node, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*key, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*now, digest.hexdigest())], names=[*key, "ends_sha256"])

    longs = ", ".join(f"{c} long" for c in key)
    lists = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(pieces, f"{longs}, conv_id long, ids string")
    return lists.repartition(*key).sortWithinPartitions(*key, "conv_id").select(*key, "ids").mapInArrow(digests, f"{longs}, ends_sha256 string")


def totals(paths: DataFrame) -> DataFrame:
    """paths: conv_id, above (the path that it hangs at, or null), leaves, saved_tokens: its own. Returns conv_id and sums of both over it and all paths below it."""
    inner = paths.select(F.col("above").alias("conv_id")).where("conv_id is not null").distinct().withColumn("inner", F.lit(True))
    told = saved(paths.join(inner, "conv_id", "left"), "paths")
    # most paths have none below: they are added to those above at once
    outer = told.where("inner is null").select("conv_id", "leaves", "saved_tokens")
    below = told.where("inner is null and above is not null").groupBy("above").agg(F.sum("leaves").alias("l"), F.sum("saved_tokens").alias("s")).withColumnRenamed("above", "conv_id")
    plus = lambda rows, more: rows.join(more, "conv_id", "left").select("conv_id", "above", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"))
    rest = saved(plus(told.where("inner"), below), "inner")
    while not rest.where("above is not null").isEmpty():
        up = rest.where("above is not null").groupBy("above").agg(F.sum("leaves").alias("l"), F.sum("saved_tokens").alias("s")).withColumnRenamed("above", "conv_id")
        further = lookup(rest, rest.select(F.col("conv_id").alias("above"), F.col("above").alias("further")), ["above"]).select("conv_id", F.col("further").alias("above"), "leaves", "saved_tokens")
        rest = saved(plus(further, up), "doubled")
    return rest.select("conv_id", "leaves", "saved_tokens").unionByName(outer)


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    nodes, ends, prints = verified(conversations)
    fs, qs = ([f"{x}{k}" for k in range(prints)] for x in "fq")
    zeros = [F.lit(0).cast("long").alias(c) for c in fs]
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(F.lit(0).cast("long").alias("depth"), *zeros, *(F.lit(None).cast("long").alias(c) for c in qs), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))
    nodes = nodes.unionByName(root)
    key, above = ["depth", *fs], [(F.col("depth") - 1).alias("depth"), *(F.col(q).alias(f) for f, q in zip(fs, qs, strict=True))]
    children = nodes.where("depth > 0").groupBy(*above).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, key, "left").join(listed(ends, fs), key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = saved(nodes.select("*", ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"), (F.col("depth") - 1).alias("up")), "children")
    parents = nodes.where("n_children > 0").select(F.col("depth").alias("up"), *(F.col(f).alias(q) for f, q in zip(fs, qs, strict=True)), F.col("conv_id").alias("parent_conv_id"))
    nodes = saved(lookup(nodes, parents, ["up", *qs]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")), "parents")
    leaf = (F.col("n_children") == 0).cast("long")
    paths = saved(nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.min_by("parent_conv_id", "depth").alias("above"), F.sum(leaf).alias("leaves"), F.sum("saved_tokens").alias("saved_tokens")), "tops")
    hanging = totals(paths.drop("top")).join(paths.where("above is not null").select("conv_id", "above", (F.col("top") - 1).alias("depth")), "conv_id")
    hanging = hanging.groupBy(F.col("above").alias("conv_id"), "depth").agg(F.sum("leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    # a node's sums are those from the end of its path up to it
    rows = nodes.join(hanging, ["conv_id", "depth"], "left").withColumn("leaves", leaf + F.coalesce("l", F.lit(0))).withColumn("saved", F.col("saved_tokens") + F.coalesce("s", F.lit(0)))
    order = [F.asc("conv_id"), F.desc("depth")]
    rows = running(rows.drop("l", "s", "saved_tokens"), "conv_id", order, order, sums=("leaves", "saved"), name="rolled")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves_to").alias("n_leaves"), F.col("saved_to").alias("saved_tokens"), "ends_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH steps AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || list_transform(range(8), lambda x: 0::BIGINT), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM range(256) AS r(i))),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, n, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id), steps),
rebuilt AS (
  SELECT c.conv_id, t.p AS d, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.p <= c.h
  UNION ALL
  SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + t.p - c.h, t.role, t.text
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.p > c.h LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20),
paths AS (
  SELECT conv_id, coalesce(path, []) AS path
  FROM convs LEFT JOIN (SELECT conv_id, list({'role': role, 'text': text} ORDER BY d) AS path FROM rebuilt GROUP BY conv_id) USING (conv_id)),
prefixes AS (SELECT conv_id, path[1:d] AS prefix, d AS depth, d = len(path) AS ends FROM paths, unnest(range(0, len(path) + 1)) AS r(d)),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    CASE WHEN depth > 0 THEN len(regexp_extract_all(prefix[depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
  FROM prefixes GROUP BY prefix, depth),
children AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
sums AS (
  SELECT n.prefix[1:d] AS prefix, count(*) FILTER (c.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens
  FROM nodes n LEFT JOIN children c USING (prefix), unnest(range(0, n.depth + 1)) AS r(d) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (prefix) LEFT JOIN children c USING (prefix) LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[1:n.depth - 1]
"""
