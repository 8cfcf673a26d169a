import numpy as np

from tidelog.llm import langid


def test_held_out_accuracy(spark, docs):
    net = langid.train(docs)
    got = langid.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) > 0
    assert all(0 <= r.score <= 1 for r in got)


def test_split(spark, docs):
    import zlib

    got = {r.doc_id: r.held_out for r in langid.identify(docs, None).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in got.items())


def test_odd_rows(spark, docs, odd, none):
    net = langid.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, net).collect()}
    assert got[2] == got[3] == got[6] == got[7] == ("und", 0.0)
    assert got[1][0] in net.langs and got[5][0] in net.langs
    assert langid.identify(none, net).count() == 0 and langid.train(none) is None
    kept = langid.assign(odd, net)
    assert kept.schema == odd.schema and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 4, 5]
    assert all(r.lang == got[r.doc_id][0] for r in kept.collect())
    assert sorted((r.doc_id or 0, r.lang) for r in langid.assign(odd, None).collect()) == [(0, "de"), (1, "en"), (4, "en"), (4, "en"), (5, "en")]


def test_more_labels_than_a_thousand(spark):
    rows = [(4 * i, f"label number {i} has words of its own, as {i * 7919 % 10007}", f"l{i:04d}") for i in range(1100)]
    x = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(~langid.held_out())
    n = x.count()
    epochs, langid.EPOCHS = langid.EPOCHS, 1
    try:
        assert len(langid.train(x).langs) == n
    finally:
        langid.EPOCHS = epochs


def test_network_against_loops():
    """Responses, maximum and softmax as plain loops, and gradients as differences of the loss."""
    rng = np.random.default_rng(4)
    net = langid.ByteCnn.fresh(["a", "b", "c"])
    net.bias += rng.normal(0, 0.1, net.bias.shape).astype(np.float32)
    for name in ("bias", "dense", "dense_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.conv = [c.astype(np.float64) for c in net.conv]
    x = rng.integers(97, 102, (4, 12)).astype(np.uint8)
    y = np.array([0, 1, 2, 1])

    def logits(row):
        hidden = []
        for f in range(len(net.bias)):
            width = sum(f < c.shape[1] for c in net.conv)
            spots = [sum(net.conv[k][row[i + k] if i + k < len(row) else 0, f] for k in range(width)) for i in range(len(row))]
            hidden.append(max(0.0, max(spots) + net.bias[f]))
        return [sum(h * net.dense[f, j] for f, h in enumerate(hidden)) + net.dense_bias[j] for j in range(3)]

    assert np.allclose(net.logits(x), [logits(r) for r in x])

    def loss():
        z = np.array([logits(r) for r in x])
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(4), y]))

    params = [*net.conv, net.bias, net.dense, net.dense_bias]
    for p, g in zip(params, net.gradients(x, y), strict=True):
        cells = sorted(np.ndindex(p.shape), key=lambda c: -abs(g[c]))[:4]
        for c in cells:
            now = p[c]
            p[c] = now + 1e-5
            up = loss()
            p[c] = now - 1e-5
            down = loss()
            p[c] = now
            assert abs((up - down) / 2e-5 - g[c]) < 1e-4


def test_prediction_covers_the_whole_text(spark, docs):
    """Scores are the mean of all windows by their bytes: an early language loses to a longer late one."""
    net = langid.train(docs)
    text = {r.lang: r.text for r in docs.where("length(text) between 400 and 3000 and lang is not null").collect()}
    a, b = sorted(text)[:2]
    long = text[a][:300] + " " + text[b] * 6
    lang, score = net.predict([long])
    raw = long.lower().encode()
    parts = [raw[i : i + langid.WINDOW] for i in range(0, len(raw), langid.WINDOW)]
    total = np.zeros(len(net.langs))
    for q in parts:
        z = net.logits(np.frombuffer(q.ljust(langid.WINDOW, b"\0"), dtype=np.uint8)[None, :])[0].astype(float)
        total += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * len(q)
    assert lang[0] == b == net.langs[total.argmax()] and abs(score[0] - total.max() / len(raw)) < 1e-5


def test_training_is_repeatable(spark, docs):
    a, b = langid.train(docs), langid.train(docs)
    assert all((x == y).all() for x, y in zip(a.conv, b.conv, strict=True))
