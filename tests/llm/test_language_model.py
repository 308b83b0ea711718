import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from radiolith.llm import lm

EXTRA = "word string, c long, ids string, n long, rare string, held_out string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None, None, None) for r in rows], f"doc_id long, text string, {EXTRA}").repartition(3)


def lexicon_of(counts, vocabulary=64):
    words = list(counts)
    out = lm.Lexicon(words, np.array([counts[w] for w in words]), sum(counts.values()), len(words), vocabulary)
    for w in out.words[out.known :]:
        out.rare_tokens[lm.rare_class(w)] += counts[w]
        out.rare_types[lm.rare_class(w)] += 1
    return out


def test_gradients_are_right():
    lexicon = lexicon_of({b"": 5, b"a": 9, b"b": 8, b"c": 7, b"d": 6})
    model = lm.Gru(lexicon, hidden=4)
    for n in model.NAMES:
        setattr(model, n, getattr(model, n).astype(np.float64))
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 5, 7), rng.integers(0, 5, 5), np.array([1, 66, 2])]
    places, fresh, _ = next(lm.lanes_of(docs, 2, 20))

    def loss():
        h, states = np.zeros((4, 2)), []
        for ids, new in zip(places, fresh):
            h = h[:, : len(ids)].copy()
            h[:, new] = 0
            states.append(h)
            h = model.step(h, ids)
        return -model.output(np.concatenate(states, axis=1), np.concatenate(places))[0].sum()

    _, grads, _ = model.gradients(np.zeros((4, 2)), places, fresh)
    for name in model.NAMES:
        p = getattr(model, name)
        for at in rng.integers(0, p.size, 12):
            i = np.unravel_index(at, p.shape)
            old = p[i]
            p[i] = old + 1e-5
            up = loss()
            p[i] = old - 1e-5
            down = loss()
            p[i] = old
            assert grads[name][i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_output_is_a_distribution():
    counts = {b"": 40} | {bytes([97 + i % 26, 97 + i // 26]): 100 - i for i in range(90)}
    lexicon = lexicon_of(counts)
    model = lm.Gru(lexicon, hidden=4)
    s = np.random.default_rng(1).normal(size=(4, 1)).astype(np.float32)
    known = np.arange(lexicon.known)
    total = np.exp(model.output(np.repeat(s, len(known), axis=1), known)[0]).sum()
    base = lexicon.classes * lm.CLASS_SIZE
    for r in range(lm.RARE_CLASSES):
        share = np.exp(model.output(s, np.array([base + r]))[0][0])
        words = [w for w in lexicon.words[lexicon.known :] if lm.rare_class(w) == r]
        floor = lexicon.rare_tokens[r] + lexicon.rare_types[r] + 1
        total += share * (sum((counts[w] + 1) / floor for w in words) + 1 / floor)  # and one unseen type
    assert total == pytest.approx(1.0, abs=1e-4)


def test_lanes_hold_every_token_in_order():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 99, n) for n in (5, 1, 30, 7, 7, 2, 64)]
    seen = {i: [] for i in range(len(docs))}
    starts = 0
    for tokens, fresh, owners in lm.lanes_of(docs, 3, 4):
        for t, f, o in zip(tokens, fresh, owners):
            starts += len(f)
            for x, i in zip(t, o):
                seen[i].append(x)
    assert starts == len(docs) and all(seen[i] == list(d) for i, d in enumerate(docs))


def test_likelihood_doesnt_depend_on_neighbours():
    lexicon = lexicon_of({b"": 5, b"a": 9, b"b": 8})
    model = lm.Gru(lexicon)
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 3, n).astype(np.int16) for n in (50, 3, 200, 1, 17)]
    together = lm.log_likelihoods(model, docs)
    alone = [lm.log_likelihoods(model, [d])[0] for d in docs]
    assert np.allclose(together, alone, rtol=1e-4)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(4)
    words = [b"", *(bytes([97 + i]) for i in range(10))]
    docs = [np.array([1 + (s + j) % 10 for j in range(40)] + [0], dtype=np.int16) for s in rng.integers(0, 10, 3000)]
    counts = Counter(x for d in docs for x in d.tolist())
    lexicon = lm.Lexicon(words, np.array([10**6, *(10**5 - i for i in range(10))]), sum(counts.values()), 11, 64)
    model = lm.Gru(lexicon)
    place = {w: i for i, w in enumerate(lexicon.words)}
    docs = [np.array([place[words[x]] for x in d], dtype=np.int16) for d in docs]
    before = lm.log_likelihoods(model, docs[:50]).sum()
    lm.train(model, (docs[i : i + 60] for i in range(0, len(docs), 60)))
    after = lm.log_likelihoods(model, docs[:50]).sum()
    assert after > 0.5 * before  # log-likelihoods are negative


def corpus(n=300):
    rng = np.random.default_rng(5)
    two = [["alpha", "beta", "gamma", "delta"], ["uno", "dos", "tres", "cuatro"]]
    rows = []
    for i in range(n):
        words = rng.choice(two[i % 2], size=rng.integers(1, 60)).tolist() + [f"w{rng.integers(0, 400)}" for _ in range(3)]
        rows.append((i, " ".join(words).title()))
    return rows


def test_scores(spark):
    rows = corpus() + [(900, None), (901, ""), (902, "zz " * 30_000), (903, "É é Alpha"), (903, "É é Alpha"), (None, "alpha nobody")]
    got = lm.score(docs_of(spark, rows), lexicon_words=50).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count: Counter = Counter()
    for i, t in rows:
        if not held(i):
            count.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(count.values()), len(count)
    want = {}
    for i, t in rows:
        words = [*(t or "").encode().lower().split(), b""]
        want[i] = (held(i), len(words), sum(count[w] > 0 for w in words), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words))
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], rel=1e-9) and r["score"] < 0 and math.isfinite(r["score"])
    unseen = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_nothing_to_learn_from(spark):
    assert lm.score(docs_of(spark, [])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.score(docs_of(spark, [(held, "one two")])).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (True, 3, 0, 0, 0.0) and math.isfinite(r["score"])


def test_scores_do_not_follow_the_file_layout(spark, monkeypatch):
    monkeypatch.setattr(lm, "TASK_TOKENS", 1500)  # several tasks
    monkeypatch.setattr(lm, "FAN_IN", 2)
    frame = docs_of(spark, corpus(400))
    one, many = ({r["doc_id"]: r["score"] for r in lm.score(frame.coalesce(1) if parts == 1 else frame.repartition(parts, "text"), lexicon_words=50).collect()} for parts in (1, 6))
    assert one.keys() == many.keys() and all(one[i] == pytest.approx(many[i], rel=1e-5) for i in one)


def test_words_of_a_batch_are_those_of_each_text():
    texts = ["left out", None, "", " \t\x0b\x0c\r\n ", "  AÉb  x\x85y\x1cz  A", "one\0two ONE\n", "alpha 中文 alpha zz zz zy"]
    for whole in (pa.array(texts), pa.array(texts, pa.large_string())):
        batch = whole.slice(1)
        want = [(t or "").encode().lower().split() for t in texts[1:]]
        words, sizes = lm.words_of(batch)
        assert sizes.tolist() == list(map(len, want)) and [w.encode() for w in words.to_pylist()] == sum(want, [])
        lexicon = lexicon_of({b"": 9, b"alpha": 5, b"a": 4, b"one": 3})
        codes, ids, starts, rare = lm._Coder(lexicon)(batch)
        place = {w: i for i, w in enumerate(lexicon.words)}
        for i, own in enumerate(want):
            at = slice(starts[i], starts[i + 1])
            assert codes[at].tolist() == [place.get(w, -1) for w in [*own, b""]]
            assert ids[at].tolist() == [place.get(w, lexicon.classes * lm.CLASS_SIZE + lm.rare_class(w)) for w in [*own, b""]]
            assert {r["word"]: r["n"] for r in rare[i].as_py()} == Counter(w for w in own if w not in place)


def test_first_round_has_tasks_for_its_share_of_tokens(spark, monkeypatch):
    monkeypatch.setattr(lm, "TASK_TOKENS", 600)
    trained, write = [], lm.materialize

    def counted(df, name):
        out = write(df, name)
        if name == "trained":
            trained.append(out.count())
        return out

    monkeypatch.setattr(lm, "materialize", counted)
    lm.score(docs_of(spark, corpus(400)), lexicon_words=50)
    tasks = max(trained)
    assert tasks > 8 and trained[0] <= -(-tasks // lm.FIRST_SHARE) + 1  # each task of either round has tokens for a task; all had one in the first round too


def plain_score(model, lexicon, count, text):
    """The document's log10 probability, a token after the other in double precision, from the equations alone."""
    words = [*(text or "").encode().lower().split(), b""]
    place = {w: i for i, w in enumerate(lexicon.words)}
    p = {n: getattr(model, n).astype(np.float64) for n in model.NAMES}
    d, known = model.hidden, lexicon.classes * lm.CLASS_SIZE
    h, total = np.zeros(d), 0.0
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    log_softmax = lambda x: x - np.log(np.exp(x - x.max()).sum()) - x.max()
    for w in words:
        i = place.get(w, len(lexicon.words))
        rare = i >= lexicon.known
        token = known + lm.rare_class(w) if rare else i
        c = lexicon.classes + lm.rare_class(w) if rare else i // lm.CLASS_SIZE
        total += log_softmax(p["cls"] @ h + p["cls_b"][:, 0])[c]
        if rare:
            r = lm.rare_class(w)
            total += math.log((count[w] + 1) / (lexicon.rare_tokens[r] + lexicon.rare_types[r] + 1))
        else:
            total += log_softmax(p["word"][c] @ h + p["word_b"][c][:, 0])[i % lm.CLASS_SIZE]
        x, u = p["input"][:, token], p["state"] @ h
        update, reset = sigmoid(2 * (x[:d] + u[:d])), sigmoid(2 * (x[d : 2 * d] + u[d : 2 * d]))
        new = np.tanh(x[2 * d :] + reset * u[2 * d :])
        h = update * h + (1 - update) * new
    return total / math.log(10)


def test_scores_equal_the_plain_recurrence(spark, monkeypatch):
    fitted = []
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda coded, shared, rate: fitted.append((fit(coded, shared, rate), shared.value)) or fitted[-1][0])
    rows = [*corpus(200), (900, None), (901, "alpha " * 400), (902, "never seen words, ÉÉ"), (903, "É Uno w3 w4 w5 alpha")]
    got = {r["doc_id"]: r["score"] for r in lm.score(docs_of(spark, rows), lexicon_words=30).collect()}
    count: Counter = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*(t or "").encode().lower().split(), b""])
    model, lexicon = fitted[0]
    for i, t in rows:
        assert got[i] == pytest.approx(plain_score(model, lexicon, count, t), rel=1e-4)
