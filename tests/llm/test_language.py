import random
import zlib

import numpy as np

from textmill.llm import language as L

ENDS = {"aa": ["tion", "ing", "the", "of"], "bb": ["ieux", "ment", "la", "é"], "cc": ["keit", "und", "der", "ö"]}
SCHEMA = "doc_id long, text string, lang string, score double, letters boolean"


def corpus(n=400):
    rng = random.Random(1)
    out = []
    for i in range(n):
        lang = rng.choice(list(ENDS))
        out.append((i, " ".join("".join(rng.choices(ENDS[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 200))), lang, 0.0, False))
    return out


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    net = L.fit(docs.where(~L.held_out(4, 2)).select("doc_id", "text", "lang"))
    out = {r.doc_id: r for r in L.predict(docs, net).collect()}
    test = [(i, lang) for i, _, lang, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(test) > 50 and np.mean([out[i].lang_pred == lang for i, lang in test]) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values())


def test_edge_cases(spark):
    rows = corpus(60) + [(1000, None, "aa", 0.0, True), (1001, "", None, 0.0, True), (1002, "123 %% \n", "bb", 0.0, True), (1003, "the", None, 0.0, True), (1004, "la ieuxment " * 30_000, None, 0.0, True)]
    docs = spark.createDataFrame(rows, SCHEMA)
    net = L.fit(docs)
    out = {r.doc_id: r for r in L.predict(docs, net).collect()}
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and out[1003].lang_pred in ENDS and out[1004].lang_pred == "bb"
    assert {r.lang_pred for r in L.predict(docs, L.fit(docs.where("lang = 'none'"))).collect()} == {"und"}
    assert L.predict(docs.limit(0), net).collect() == []


def test_windows():
    text = np.arange(600) % 250
    w = L.cut(text.astype(np.uint8), 256)
    assert w.shape == (3, 256) and w.reshape(-1)[:600].tolist() == text.tolist() and not w.reshape(-1)[600:].any()
    net = L.train([b"aaaa", b"bbbb"] * 40, ["x", "y"] * 40, window=16, epochs=3)
    assert np.allclose(net.highest(L.cut(text.astype(np.uint8), 16)), net.pooled(L.cut(text.astype(np.uint8), 16))[0])
    assert net.probabilities(L.cut(np.frombuffer(b"aaaa", np.uint8), 16)).argmax() == 0


def test_forward_and_gradient():
    """The network's probabilities filter by filter, and its gradient by small steps."""
    rng = np.random.default_rng(5)
    net = L.train([b"abcab", b"xyzzy", b"qwert"] * 9, ["x", "y", "z"] * 9, window=12, filters=4, epochs=2)
    x, y, share = rng.integers(97, 123, (6, 12)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2]), np.array([0.1, 0.2, 0.3, 0.1, 0.2, 0.1])

    def probabilities(row):
        top = [max(sum(t[j, row[i + j], f] for j in range(w)) for i in range(len(row) - w + 1)) for w, t in net.tables.items() for f in range(t.shape[2])]
        hidden = [max(0.0, float(v) + float(b)) for v, b in zip(top, net.bias)]
        z = np.array([sum(h * float(net.out[k, c]) for k, h in enumerate(hidden)) + float(net.out_bias[c]) for c in range(3)])
        return np.exp(z) / np.exp(z).sum()

    assert np.allclose(net.probabilities(x), [probabilities(r) for r in x], atol=1e-4)
    loss = lambda: sum(-s * np.log(probabilities(r)[k]) for r, k, s in zip(x, y, share))
    for q, g in zip([*net.tables.values(), net.bias, net.out, net.out_bias], L.gradient(net, x, y, share), strict=True):
        for at in [np.unravel_index(int(np.abs(g).argmax()), g.shape), tuple(0 for _ in g.shape)]:
            before, step = q[at], 1e-2
            q[at] = before + step
            up = loss()
            q[at] = before - step
            down = loss()
            q[at] = before
            assert abs((up - down) / (2 * step) - g[at]) < 2e-2 * max(1.0, abs(g[at]))


def test_kept_documents(spark):
    """Rows are decided on one by one, whatever their ids; those without a language get one."""
    rows = [*corpus(80), (None, "the of tion ing " * 9, None, 0.0, False), (3, "12 %%", "aa", 0.0, False), (None, None, None, 0.0, False)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("letters0", L.F.lit(1))
    net = L.fit(docs)
    out = L.kept_documents(docs, net, 0.5)
    assert out.columns == docs.columns and [r.lang for r in out.where("doc_id is null").collect()] == ["aa"]
    assert out.count() == 81 and {r.lang for r in L.kept_documents(docs, net, 0.5, wanted=("bb",)).collect()} == {"bb"}
    assert L.kept_documents(docs, None, 0.5).count() == 0
