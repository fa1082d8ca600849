import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from textmill.llm import packing as P
from textmill.llm.shared import vocabulary

ODD = ["", None, " a", "a ", "a  b", "a\n\nb", "a \n b", "tab\there", "nb\u00a0sp", "it's we'll 12 3½ x_y <|endoftext|> z<|endoftext|>", "\x1cab", "é😀\nÉa ê", "\n", " ", "a\r\nb", "x\x00y \x01z"]


@pytest.mark.parametrize("known", [600_000, 500])
def test_encoder_equals_tokenizer(spark, monkeypatch, known):
    monkeypatch.setattr(P, "KNOWN", known)
    file = vocabulary("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(file), P.Encoder("byte_bpe_50k")
    texts = [t or "" for t in ODD] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def check(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) == len(ids[i]) and all(r.length == capacity for r in own[1:]) and 0 < own[0].length <= capacity
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[i][r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) <= capacity
    return len(by_sequence), sum(map(len, ids.values())) / capacity


def test_pack(spark):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choices(["the", "stone", "an", "tion", "è"], k=rng.randrange(0, 90))) for i in range(600)} | {1000 + i: t for i, t in enumerate(ODD)} | {2000: "word " * 3000}
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()], "doc_id long, text string, bin int, offset int")
    for group in (20, 100_000):
        used, least = check(P.pack(docs, capacity=64, group_pieces=group, fan=3, hosts=4).collect(), texts, 64)
        assert used <= 1.06 * least + 1


def test_tree_is_near_the_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    used, least = check(P.pack(docs, group_pieces=200).collect(), texts, 2048)
    assert used <= 1.01 * least + 1


def test_empty_and_repeated(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert len(P.pack(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string")).collect()) == 2
