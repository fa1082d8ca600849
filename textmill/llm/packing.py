"""Best-fit packing of documents into sequences of a fixed number of tokens, as a tree of residuals.

tokenised() gives each document's pieces: sizes and checksums, no text. local() deals the pieces out to groups of a bounded
size and packs each by best fit, largest first. Bins that nothing can be added to are final. Of the others a group sends up
those that can matter: in any best-fit packing two bins of one group never fit together, so at most one is half full or
less, and it needs one host in some other group; the roomiest hosts go up with it. merged() takes the bins of `fan` groups as
items for the next best-fit round, until one group is left. Every round is a Spark job whose tasks hold a bounded number
of bins, and is written to the shared folder.

Defined results: a null text is an empty one and has one piece, its end token. Repeated rows, and rows with null doc_id, have pieces
of their own; equal (doc_id, piece) then occur more than once. No rows give none. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from array import array
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import blocks, saved, table, utf8, vocabulary

CAPACITY = 2048
END = 0
#: Pieces that one task packs.
GROUP_PIECES = 50_000
#: Bins over half full that a group sends up, and groups that meet in a round.
HOSTS, FAN = 64, 8
#: Words whose ids a worker remembers.
KNOWN = 600_000

_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of texts by a byte-level BPE whose words begin at white space, word by word with a memory.

    Words go to tiktoken, which has the same vocabulary as ranks and is faster. Texts with other white space than single
    spaces and newlines between words, or with something like a special token, go to the tokenizer whole.
    """

    def __init__(self, name: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(f"{name}.json"))
        with open(vocabulary(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        self.words = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _split(text: str) -> list[str] | None:
        """Words, each with a mark of what stands before it: \\x01 nothing, \\x00 a newline, none a space."""
        if any(x in text for x in ("  ", "\n\n", " \n", "\n ", "\x00", "\x01", "<|")) or text[:1] in " \n" or text[-1:] in " \n":
            return None
        words = ("\x01" + text.replace("\n", " \x00")).split(" ")
        return words if len(text.split()) == len(words) else None  # else there is other white space

    def _ids(self, word: str) -> bytes:
        plain = word[1:] if word[0] == "\x01" else "\n" + word[1:] if word[0] == "\x00" else " " + word
        return array("I", self.words.encode_ordinary(plain)).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [self._split(t) for t in texts]
        known = self.known
        for word in {w for words in split if words for w in words if w not in known}:
            if len(known) >= KNOWN:
                known.clear()
                return [b"".join(map(self._ids, words)) if words else self._whole(t) for t, words in zip(texts, split, strict=True)]
            known[word] = self._ids(word)
        return [b"".join(map(known.__getitem__, words)) if words else self._whole(t) for t, words in zip(texts, split, strict=True)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def tokenised(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def pieces(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(tokenizer)
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            for i, j in blocks(utf8(texts)[1]):
                out = []
                for doc, ids4 in zip(ids[i:j], encode([t or "" for t in texts.slice(i, j - i).to_pylist()]), strict=True):
                    ids4 += END.to_bytes(4, "little")
                    total = len(ids4) // 4
                    first = (total - 1) % capacity + 1
                    cuts = [0, *range(first, total + 1, capacity)]
                    out += [(doc, k, a, z - a, zlib.crc32(ids4[4 * a : 4 * z])) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PIECE, strict=True)], schema=_PIECE)

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECE)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """For items in this order: bin and offset of each; the bins' fills."""
    place, offset, fills = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    rooms: dict[int, list[int]] = {}
    order: list[int] = []  # the rooms that some bin has, ascending
    for i, size in enumerate(sizes.tolist()):
        at = bisect_right(order, size - 1)
        if at == len(order):
            b, room = len(fills), capacity
            fills.append(0)
        else:
            room = order[at]
            b = rooms[room].pop()
            if not rooms[room]:
                order.pop(at)
        place[i], offset[i] = b, fills[b]
        fills[b] += size
        if room := room - size:
            if not rooms.get(room):
                rooms[room] = []
                order.insert(bisect_right(order, room), room)
            rooms[room].append(b)
    return place, offset, fills


def carried(fills: np.ndarray, smallest: int, capacity: int, hosts: int) -> np.ndarray:
    """Which bins go up: all that are at most half full, and the roomiest others that still have room for the smallest piece."""
    up = fills <= capacity // 2
    rest = np.flatnonzero(~up & (capacity - fills >= smallest))
    up[rest[np.argsort(fills[rest], kind="stable")[:hosts]]] = True
    return up


def local(pieces: DataFrame, groups: int, smallest: int, capacity: int = CAPACITY, hosts: int = HOSTS) -> DataFrame:
    """The pieces with bin, group, offset, fill of the bin, and whether the bin goes up."""

    def pack(batches):
        from pyspark import TaskContext

        group = TaskContext.get().partitionId()
        t = pa.Table.from_batches(list(batches), _PIECE)
        if not t.num_rows:
            return
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        place, offset, fills = best_fit(t.column("length").to_numpy(), capacity)
        fills = np.array(fills)
        up = carried(fills, smallest, capacity, hosts)
        t = t.append_column("bin", pa.array(place + (group << 32))).append_column("group", pa.array(np.full(len(place), group)))
        t = t.append_column("offset", pa.array(offset)).append_column("fill", pa.array(fills[place])).append_column("up", pa.array(up[place]))
        yield from t.to_batches(10_000)

    return pieces.repartition(groups, "row").drop("row").mapInArrow(pack, PIECE + ", bin long, group long, offset long, fill long, up boolean")


def merged(bins: DataFrame, smallest: int, capacity: int = CAPACITY, hosts: int = HOSTS) -> DataFrame:
    """bins: bin, group, fill. Returns for each the bin it is now part of, its offset there, that bin's fill, and whether that goes up."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["fill", "bin"], ascending=[False, True])
        place, offset, fills = best_fit(part["fill"].to_numpy(), capacity)
        fills = np.array(fills)
        _, first = np.unique(place, return_index=True)
        up = carried(fills, smallest, capacity, hosts)
        # a bin keeps the number of its largest part
        return pd.DataFrame({"bin": part["bin"], "group": part["group"], "into": part["bin"].to_numpy()[first][place], "shift": offset, "fill": fills[place], "up": up[place]})

    return bins.groupBy("group").applyInPandas(pack, "bin long, group long, into long, shift long, fill long, up boolean")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k", group_pieces: int = GROUP_PIECES, fan: int = FAN, hosts: int = HOSTS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    # numbered once and for all, so that repeated rows are dealt to groups like others
    pieces = saved(tokenised(docs, capacity, tokenizer).withColumn("row", F.monotonically_increasing_id()), "pieces")
    n, smallest = pieces.agg(F.count("*"), F.coalesce(F.min("length"), F.lit(1))).first()
    groups = max(1, math.ceil(n / group_pieces))
    packed = saved(local(pieces, groups, smallest, capacity, hosts), "packed")
    bins = packed.where("up and offset = 0").select("bin", "group", "fill")
    ends = bins.select("bin", F.col("bin").alias("sequence_id"), F.lit(0).cast("long").alias("moved"))
    groups = bins.agg(F.coalesce(F.max("group"), F.lit(0)) + 1).first()[0]
    while groups > 1:
        groups = math.ceil(groups / fan)
        step = saved(merged(bins.withColumn("group", F.expr(f"`group` div {fan}")), smallest, capacity, hosts), "round")
        ends = saved(
            ends.join(step.select(F.col("bin").alias("sequence_id"), "into", "shift"), "sequence_id", "left").select("bin", F.coalesce("into", "sequence_id").alias("sequence_id"), (F.col("moved") + F.coalesce("shift", F.lit(0))).alias("moved")),
            "ends",
        )
        bins = step.where("up and shift = 0").select(F.col("into").alias("bin"), "group", "fill")
    return packed.join(ends, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("moved", F.lit(0))).alias("offset")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
