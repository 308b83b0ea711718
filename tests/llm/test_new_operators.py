"""Quality rules, vector codes and phrases against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiolith.llm import codes, phrases, quality

# --- phrases -------------------------------------------------------------------------------------------------------

TEXT_SCHEMA = "doc_id long, text string, lang string, n long, words int, phrase string, hashes string, `a.b` string"


def texts(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, lang, None, None, None, None, None) for i, (t, lang) in enumerate(rows)], TEXT_SCHEMA).repartition(parts)


def plain_phrases(rows, depth=3, least=10, covered=50, top=2000):
    f, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, depth + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = defaultdict(list)
    for (lang, *p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        inside = any(b >= least and 100 * b >= covered * a and len(q) > len(p) and any(list(q[i : i + len(p)]) == p for i in range(len(q))) for (other, *q), b in f.items() if other == lang)
        cut = min((1000000 * a * a // (f[(lang, *p[:k])] * f[(lang, *p[k:])]), k, f[(lang, *p[:k])], f[(lang, *p[k:])]) for k in range(1, len(p)))
        if not inside:
            found[lang].append((-cut[0], -a, " ".join(p).encode(), cut[2], cut[3]))
    return {(lang, r, p.decode(), -a, left, right, totals[lang], -s) for lang, ps in found.items() for r, (s, a, p, left, right) in enumerate(sorted(ps)[:top], 1)}


def some_texts(seed, n=150):
    r = random.Random(seed)
    words = ["a", "b", "The", "the", "É", "é", "x" * 40, "zz", "Q", "\x00", "\x1c", "c|d", "\U0001f600"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", "; "]
    rows = [("".join(r.choice(words[: r.randrange(2, 13)]) + r.choice(marks) for _ in range(r.randrange(0, 60))), r.choice(["en", "en", "de", None, "und", ""])) for _ in range(n)]
    rows += [(None, "en"), ("", "en"), ("...", None), ("New York City " * 30, "en"), ("hapax", "sw")]
    return rows + rows[:20]


@pytest.mark.parametrize("depth, shard_words, most_bits, covered, top", [(3, 1 << 20, 30, 50, 2000), (3, 40, 20, 50, 7), (5, 200, 10, 80, 2000), (2, 100, 30, 50, 3)])
def test_phrases_equal_brute_force(spark, depth, shard_words, most_bits, covered, top, monkeypatch):
    if shard_words == 40:
        monkeypatch.setattr(phrases, "STRETCH", 16)
    rows = some_texts(depth)
    got = phrases.collocations(texts(spark, rows), max_words=depth, shard_words=shard_words, most_bits=most_bits, covered=covered, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == plain_phrases(rows, depth, covered=covered, top=top)


def test_phrases_of_odd_tables(spark):
    assert phrases.collocations(texts(spark, [])).count() == 0
    assert phrases.collocations(texts(spark, [(None, None), ("", "en"), ("one two", "en")])).count() == 0
    long = ("to be or not to be " * 50_000, "en")
    assert {tuple(r) for r in phrases.collocations(texts(spark, [long])).collect()} == plain_phrases([long])


def test_full_bitmap_lets_pass_but_changes_nothing(spark):
    rows = some_texts(9, 60)
    least = phrases.collocations(texts(spark, rows), least=2, most_bits=1)
    assert {tuple(r) for r in least.collect()} == plain_phrases(rows, least=2)


def test_products_beyond_64_bits(spark):
    big = 6 * 10**12
    counts = spark.createDataFrame([("en", 1, "a", big + 7), ("en", 1, "b", big + 9), ("en", 2, "a b", big), ("en", 0, "", 3 * big)], "lang string, words int, phrase string, n long")
    assert phrases.score_candidates(counts).collect()[0]["score"] == 1000000 * big * big // ((big + 7) * (big + 9))


def test_automaton_states_are_classes_of_end_places():
    rng = np.random.default_rng(3)
    for depth in (1, 2, 3, 5):
        words = rng.choice([0, 1, 1, 2, 2, 3, 4], size=400)
        automaton = phrases.suffix_automaton(words, depth)
        ends = defaultdict(set)
        for i in range(len(words)):
            for k in range(1, depth + 1):
                if i + k <= len(words) and (words[i : i + k] > 0).all():
                    ends[tuple(words[i : i + k])].add(i + k)
        classes = defaultdict(list)
        for run, at in ends.items():
            classes[frozenset(at)].append(run)
        state = {}
        for s in range(len(automaton.place)):
            run = tuple(words[automaton.place[s] : automaton.place[s] + automaton.longest[s]])
            same = classes[frozenset(ends[run])]
            assert (len(max(same, key=len)), len(min(same, key=len)), len(ends[run])) == (len(run), automaton.shortest[s], automaton.ends[s])
            state[frozenset(ends[run])] = s
        assert len(state) == len(classes) == len(automaton.place)
        for s in range(len(automaton.place)):
            run = tuple(words[automaton.place[s] : automaton.place[s] + automaton.longest[s]])
            next_run = run[len(run) - automaton.shortest[s] + 1 :]
            assert automaton.link[s] == (state[frozenset(ends[next_run])] if next_run else -1)


# --- vector codes --------------------------------------------------------------------------------------------------

VECTOR_SCHEMA = "vec_id long, embedding array<float>, label int, n long, sums string, part int, codes string, error string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], VECTOR_SCHEMA).repartition(3)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted([(i, np.floor(np.array(v, dtype=np.float32).astype(np.float64) * 4096).astype(int).tolist(), label) for i, v, label in rows if v and None not in v and np.isfinite(v).all()], key=lambda r: (r[0] is None, r[0]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min((gap(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        taken = [[nearest(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), t in zip(kept, taken) if t[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    out, by_label = [], Counter()
    for i, v, label in kept:
        found = [nearest(v, p) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    import hashlib

    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted((i, code, error, by_label[label], digest) for i, code, error, label in out)


def some_vectors(seed, n, d, spread=0.5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(9, d))
    rows = [(int(i), [float(np.float32(x)) for x in base[i % 9] + rng.normal(size=d) * spread], [None, 1, 2][int(rng.integers(3))]) for i in rng.permutation(n) * 3 + 1]
    return rows + [(900_001, None, 1), (900_002, [float("nan")] * d, 1), (900_003, [float("inf")] + [0.0] * (d - 1), 2), (900_004, [None] + [0.5] * (d - 1), None), (900_005, [], 1), (900_006, [0.0] * d, None)]


@pytest.mark.parametrize("n, d, spread", [(300, 16, 0.5), (300, 24, 12.0), (120, 8, 0.0), (5, 16, 0.5), (1, 8, 1.0)])
def test_codes_equal_plain_rounds(spark, n, d, spread):
    rows = some_vectors(n, n, d, spread)
    got = codes.compress(vectors(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == plain_codes(rows)


def test_sums_kept_by_differences_are_those_over_all_rows():
    rng = np.random.default_rng(4)
    block = rng.integers(-40000, 40000, size=(500, 24))
    before = np.full((500, 8), 255, dtype=np.uint8)
    counts, sums = np.zeros((8, 16), int), np.zeros((8, 16, 3), int)
    for _ in range(4):
        after = np.where(rng.random((500, 8)) < 0.3, rng.integers(0, 16, (500, 8)), before).astype(np.uint8)
        n, s = codes.changes(block, before, after, 16)
        counts, sums, before = counts + n, sums + s, after
        for p in range(8):
            for e in range(16):
                own = block[after[:, p] == e, 3 * p : 3 * p + 3]
                assert counts[p, e] == len(own) and (sums[p, e] == own.sum(axis=0)).all()


def test_codes_of_odd_tables(spark):
    assert codes.compress(vectors(spark, [])).count() == 0
    assert codes.compress(vectors(spark, [(1, None, 1), (2, [1.0] * 7, 1), (None, None, None)])).count() == 0
    v = [0.25] * 8
    mixed = [(1, v, 1), (1, v, 1), (2, [1.0] * 16, 1), (3, [1.0] * 7, 1), (None, [0.5] * 8, 1), (4, [1e30] + v[1:], None)]
    got = sorted((tuple(r) for r in codes.compress(vectors(spark, mixed)).collect()), key=str)
    assert [r[0] for r in got] == [1, 1, 4, None] and len({r[4] for r in got}) == 1
    assert got[0] == got[1] and got[2][2] == got[2][3] == 0


def test_a_label_of_most_rows(spark, monkeypatch):
    monkeypatch.setattr(codes, "heavy_keys", lambda counts, n, rows: counts.where(F.col(n) > 50).withColumn("_rl_salts", F.lit(3)).drop(n))
    rows = [(i, v, 1) for i, v, _ in some_vectors(2, 200, 8)]
    assert sorted(tuple(r) for r in codes.compress(vectors(spark, rows)).collect()) == plain_codes(rows)


# --- quality -------------------------------------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def junk(r, kind):
    words = ["".join(r.choice("aeiounstr") for _ in range(r.randrange(2, 9))) for _ in range(120)]
    if kind == 0:
        return " ".join(w + r.choice(["###", "***", "$$$", "%%%"]) for w in words)
    if kind == 1:
        return " | ".join(words)
    if kind == 2:
        return " ".join(w.upper() + "!!" for w in words)
    return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, 120, 9)) + "."


def test_quality_counts_and_held_out_verdicts(spark):
    r = random.Random(6)
    odd = [None, "", " \n ", "a b c a b c", "word " * 60, "x\x1cy z\x85w", "é漢 \U0001f600 " * 30, "one line\n one line\none line\n\n\n", "a" * 300_000, "p q r " + " ".join(f"w{i}" for i in range(80)) + " p q r"]
    rows = [(i, t, 7) for i, t in enumerate(odd)] + [(1000 + i, junk(r, 3 if i % 2 else i // 2 % 3), 7) for i in range(600)]
    docs = spark.createDataFrame([(*x, None, None, None) for x in rows], "doc_id long, text string, n_words long, kept string, good string, held string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1000, 1300)] + [(1300, None, 1), (None, 0, 0), (77777, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {x["doc_id"]: x for x in quality.assess(docs, model).collect()}
    for i, text, _ in rows:
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == plain_counts(text), text
        assert x["kept"] == (not x["base_failed"] and x["probability"] >= quality.KEEP) and 0 <= x["probability"] <= 1
    held_out = [got[i] for i in range(1301, 1600)]
    assert sum(x["kept"] == bool(x["doc_id"] % 2) for x in held_out) >= 297
    # Calibration: among held-out texts the mean probability is the share of good ones.
    assert abs(np.mean([x["probability"] for x in held_out]) - 0.5) < 0.05


def test_quality_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60))), (None, "x"), (1, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = quality.assess(docs, quality.fit(docs, none)).collect()
    assert sorted((x["n_words"], x["kept"]) for x in got) == [(0, False), (1, False), (60, True)]
    assert quality.assess(docs.limit(0), quality.fit(docs.limit(0), none)).count() == 0


def test_long_texts_are_scored_by_the_same_features(monkeypatch):
    r = random.Random(8)
    data = junk(r, 3).encode()
    ids, distinct = quality._numbers(data.split())
    whole = sorted((f, x) for f, p in quality.places_of(data, ids, distinct) for x in p.tolist())
    monkeypatch.setattr(quality, "STRETCH", 50)
    assert sorted((f, x) for f, p in quality.places_of(data, ids, distinct) for x in p.tolist()) == whole


def test_regression_and_calibration_against_plain_descent():
    rng = np.random.default_rng(2)
    x = rng.random((300, 6)) * (rng.random((300, 6)) < 0.6)
    good = (x @ [3, -2, 1, 0, -3, 2] + rng.normal(size=300) * 0.3 > 0.4).astype(float)
    row, place = np.nonzero(x)
    weights, bias = quality.fit_logistic(row, place, x[row, place], good, np.ones(300), 6, ridge=1e-3, steps=4000, rate=0.05)
    theta = np.zeros(7)
    full = np.column_stack([x, np.ones(300)])
    for _ in range(60):  # Newton's method on the same loss
        p = 1 / (1 + np.exp(-full @ theta))
        ridge = np.diag([1e-3] * 6 + [0])
        theta -= np.linalg.solve(full.T @ (full * (p * (1 - p))[:, None]) / 300 + ridge, full.T @ (p - good) / 300 + ridge @ theta)
    assert np.allclose([*weights, bias], theta, atol=1e-2)
    z = rng.normal(size=20_000) * 3
    drawn = (rng.random(20_000) < 1 / (1 + np.exp(-(0.5 * z + 1)))).astype(float)
    slope, shift = quality.calibrate(z, drawn, np.ones(20_000))
    assert abs(slope - 0.5) < 0.03 and abs(shift - 1) < 0.06
