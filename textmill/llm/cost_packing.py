"""Cost-balanced packing of documents into sequences of at most a fixed number of tokens.

What a sequence costs to train on is estimated as the sum over its pieces of length * (linear + length): projections grow with
the tokens, attention inside a piece with their square. Descending by cost, each piece goes to the sequence that has cost least so
far among those with room for it, so sequences come out about equally dear, and no task waits for one that is not.

Sequences are opened for exactly the tokens that there are: full ones, and shorter ones of a power of two for what is left over,
which need no padding either. So pieces fill them without a gap. A piece that fits nowhere is cut: the cheapest sequence with room
for half of it, or else the roomiest, takes what it has room for, and the rest waits for its turn by size. Documents longer than a
sequence are cut into full pieces and a rest beforehand.

tokenised() gives pieces with their ids (full ones without: they are never cut again); one shuffle deals them out evenly by their number,
whatever the order of the table; each task packs what it gets in blocks of a bounded number of tokens as it streams by. No
table is written on the way, and nothing goes through the driver. The ids of a lost task's pieces are packed anew, all of them.

Defined results: a null text is an empty one and has one piece, its end token. Repeated rows and rows with null doc_id are documents of
their own. Pieces of equal size are taken in the order they come; sequences of equal cost by number. No rows give none. Other
columns are ignored.
"""

from __future__ import annotations

import zlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import END, encoder
from .shared import blocks, table, utf8

CAPACITY = 1024
#: Cost of a token over that of a pair of tokens in attention: six times the width of the model, here 1024.
LINEAR = 6 * 1024
#: Tokens that a task packs at a time.
BLOCK_TOKENS = 4 << 20

_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_PACKED = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "sequence_cost")])
PACKED = ", ".join(f"{c} long" for c in _PACKED.names)


def tokenised(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, ids (unsigned, of 16 bits; null for full pieces) of pieces of at most `capacity`."""

    def pieces(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(tokenizer)
        if encode.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError(f"{tokenizer} has ids of more than 16 bits")
        for b in batches:
            docs, texts = b.column("doc_id").to_pylist(), b.column("text")
            for i, j in blocks(utf8(texts)[1]):
                out = []
                for doc, ids in zip(docs[i:j], encode([t or "" for t in texts.slice(i, j - i).to_pylist()]), strict=True):
                    ids += END.to_bytes(4, "little")
                    total = len(ids) // 4
                    for a in range(0, total, capacity):
                        part = ids[4 * a : 4 * (a + capacity)]
                        n = len(part) // 4
                        out.append((doc, a, n, zlib.crc32(part), total, None if n == capacity else np.frombuffer(part, "<u4").astype("<u2").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PIECE, strict=True)], schema=_PIECE)

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECE)


def room_for(total: int, capacity: int) -> list[int]:
    """Sizes of the sequences that hold so many tokens: full ones, then powers of two."""
    full, rest = divmod(total, capacity)
    return [capacity] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def balanced(sizes: np.ndarray, capacity: int = CAPACITY, linear: int = LINEAR) -> tuple[list[tuple[int, int, int, int, int]], list[int], list[int]]:
    """(item, start in it, length, sequence, offset) of every piece; the sequences' sizes and costs. sizes: descending."""
    rooms = room_for(int(sizes.sum()), capacity)
    lengths, costs, placed = list(rooms), [0] * len(rooms), []
    # of the sequences with each room, the cheapest first; above them a tree of the least key over rooms; key: cost, then number
    leaves, none, low = 1 << capacity.bit_length(), 1 << 100, 1 << 32
    heaps: list[list[int]] = [[] for _ in range(leaves)]
    for s, room in enumerate(rooms):
        heaps[room].append(s)
    tree = [none] * leaves + [h[0] if h else none for h in heaps]
    for i in range(leaves - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def cheapest(room: int) -> int:
        """The least key among sequences with at least so much room."""
        i = leaves + room
        best = tree[i]
        while i > 1:
            if not i & 1 and tree[i + 1] < best:
                best = tree[i + 1]
            i >>= 1
        return best

    def changed(room: int) -> None:
        i = leaves + room
        tree[i] = heaps[room][0] if heaps[room] else none
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            best = a if a < b else b
            if tree[i] == best:
                break
            tree[i] = best
            i >>= 1

    def put(item: int, start: int, n: int, s: int) -> None:
        room = rooms[s]
        heappop(heaps[room])
        changed(room)
        placed.append((item, start, n, s, lengths[s] - room))
        costs[s] += n * (linear + n)
        rooms[s] = room = room - n
        if room:
            heappush(heaps[room], costs[s] * low + s)
            changed(room)

    waiting: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for item, size in enumerate(sizes.tolist()):
        waiting[size].append((item, 0))
    roomiest = capacity
    for size in range(capacity, 0, -1):
        for item, start in waiting[size]:
            key = cheapest(size)
            if key < none:
                put(item, start, size, key % low)
                continue
            key = cheapest((size + 1) // 2)
            if key == none:
                while not heaps[roomiest]:
                    roomiest -= 1
                key = heaps[roomiest][0]
            n = rooms[key % low]
            put(item, start, n, key % low)
            waiting[size - n].append((item, start + n))
    return placed, lengths, costs


def packed(pieces: DataFrame, capacity: int = CAPACITY, linear: int = LINEAR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Tokenised pieces, packed block by block where they are."""

    def block(parts: list[pa.RecordBatch], first: int):
        t = pa.Table.from_batches(parts, _PIECE).combine_chunks()
        t = t.take(pa.array(np.argsort(-t.column("length").to_numpy(), kind="stable")))
        placed, lengths, costs = balanced(t.column("length").to_numpy(), capacity, linear)
        item, start, n, s, offset = np.array(placed, np.int64).T
        crc, own, ids = t.column("ids_crc32").to_numpy()[item].copy(), t.column("length").to_numpy()[item], t.column("ids")
        for k in np.flatnonzero(n < own):
            crc[k] = zlib.crc32(np.frombuffer(ids[int(item[k])].as_py(), "<u2")[start[k] : start[k] + n[k]].astype("<u4").tobytes())
        columns = [t.column("doc_id").take(pa.array(item)).combine_chunks(), t.column("start").to_numpy()[item] + start, n, crc, t.column("doc_tokens").to_numpy()[item], s + first, offset, np.array(lengths)[s], np.array(costs)[s]]
        yield from pa.Table.from_arrays([pa.array(c, pa.int64()) if isinstance(c, np.ndarray) else c for c in columns], schema=_PACKED).to_batches(20_000)
        return len(lengths)

    def pack(batches):
        from pyspark import TaskContext

        held, tokens, first = [], 0, TaskContext.get().partitionId() << 40
        for b in batches:
            held.append(b)
            tokens += int(b.column("length").to_numpy().sum())
            if tokens >= block_tokens:
                first += yield from block(held, first)
                held, tokens = [], 0
        if tokens:
            yield from block(held, first)

    return pieces.mapInArrow(pack, PACKED)


def pack(docs: DataFrame, capacity: int = CAPACITY, linear: int = LINEAR, tokenizer: str = "byte_bpe_50k", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, sequence_cost."""
    pieces = tokenised(docs, capacity, tokenizer).withColumn("row", F.monotonically_increasing_id()).repartition(F.xxhash64("row")).drop("row")
    return packed(pieces, capacity, linear, block_tokens)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
