import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from radiolith.llm import bpe, packing, simhash, suffix_dedup, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)
#: Names that operators use for columns of their own, as extra columns of the input.
CLASHING = "fp long, ids string, start long, end long, fill int, marks string, n long, doc long, component string, piece string, score string, `a.b` string"


def docs_of(spark, rows, extra=True):
    """Rows of (doc_id, text) as a table with clashing extra columns."""
    schema = "doc_id long, text string" + (f", {CLASHING}" if extra else "")
    return spark.createDataFrame([(*r, *([None] * 12 if extra else [])) for r in rows], schema).repartition(3)


ODD = [None, "", " ", "x", "a" * 5000, "the " * 3000, "<|endoftext|>x<|endoftext|> <|endoftext|", "\x00\x1c \x1f  x", "é" * 700 + "漢字かな交じり文" * 100, "\U0001f600" * 300, "I'll we're don't 'S", " \n\n  x\t", "ˆʹᢅ" * 4, "﷐￾\U000e0001 ꟲ ㌀ 𞤀"]


def test_bpe_equals_the_library():
    r = random.Random(1)
    texts = [t for t in ODD if t is not None]
    for _ in range(800):
        texts.append("".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x600), r.randrange(0x2000, 0x3100), r.randrange(0x10000, 0x1FFFF), 32, 10, 39])) for _ in range(r.randrange(1, 80))))
    texts += ["".join(r.choice("ab") for _ in range(r.randrange(20, 400))) for _ in range(60)]
    own = bpe.load_bpe(VOCABULARY)
    for text in texts:
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_bpe_pieces_of_every_length_take_the_same_merges():
    own, r = bpe.load_bpe(VOCABULARY), random.Random(2)
    for n in range(1, 80):
        piece = "".join(r.choice("theringaso") for _ in range(n)).encode()
        assert list(own._encode_long(piece)) == np.frombuffer(own.encode_pieces([piece])[0], "<u4").tolist()


def test_bpe_pieces_survive_forgetting(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_LIMIT", 5)
    own = bpe.ByteBPE(VOCABULARY)
    texts = ["alpha beta gamma delta epsilon zeta eta theta iota"] * 3 + ["kappa lambda mu nu xi omicron pi rho sigma"] * 2
    for _ in range(3):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_packed(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_invalid_bytes_decode_as_in_the_library():
    own = bpe.load_bpe(VOCABULARY)
    ids = own.encode("é漢")[:-1]
    assert own.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_round_trip_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "x"), (None, "null id")]
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs_of(spark, rows), VOCABULARY).collect()}
    want = set()
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    assert bpe.round_trip(docs_of(spark, []), VOCABULARY).count() == 0


def test_encode_and_decode_columns(spark):
    df = bpe.encode_texts(docs_of(spark, [(1, "hello <|endoftext|>"), (2, None)], extra=False), VOCABULARY)
    back = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.decode_ids(df, VOCABULARY).collect()}
    assert back[1] == (LIBRARY.encode("hello <|endoftext|>", add_special_tokens=False).ids, "hello <|endoftext|>") and back[2] == ([], "")


# --- SimHash -------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components_of(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_fingerprint():
    r = random.Random(3)
    for text in [None, "", "One", "one TWO", "É é x", "a b c", "\x0b a\x0cb \x85c", *(" ".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(r.randrange(1, 400))) for _ in range(30))]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_anchors_cover():
    r = np.random.default_rng(4)
    half = r.integers(0, 1 << 32, 500)
    home, reached = simhash.anchors_of(half)
    assert (np.bitwise_count(home ^ half) <= 1).all()
    assert (simhash._syndrome(home & 0x7FFFFFFF) == 0).all()
    near = half ^ (np.int64(1) << r.integers(0, 32, 500))  # anything one bit away comes to the home of the other
    _, of_near = simhash.anchors_of(near)
    assert np.any([a == home for a in of_near], axis=0).all()


@pytest.mark.parametrize("home_part", [1024, 3])
def test_links_equal_brute_force(spark, home_part):
    r = random.Random(5)
    fps = {}
    for base in range(12):
        center = r.getrandbits(64) if base else 0
        for _ in range(14):
            fps[center] = None
            for b in r.sample(range(64), r.randrange(0, 4)):
                center ^= 1 << b
    fps = list(fps)
    for i in range(40):
        fps.append(fps[0] ^ (1 << i))
    fps = list(dict.fromkeys(fps))
    classes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, doc long")
    links = simhash.near_links(classes, home_part=home_part).collect()
    assert all(bin(fps[x["a"]] ^ fps[x["b"]]).count("1") <= 64 for x in links)
    got = components_of(range(len(fps)), lambda a, b: False)
    edges = {(x["a"], x["b"]) for x in links} | {(x["b"], x["a"]) for x in links}
    got = components_of(range(len(fps)), lambda a, b: (a, b) in edges)
    assert got == components_of(range(len(fps)), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 3)


def test_near_duplicates_rows(spark):
    r = random.Random(6)
    base = [" ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(300)) for _ in range(4)]
    rows = []
    for i in range(40):
        words = base[i % 4].split()
        if i % 3:
            words[r.randrange(300)] = "changed"
        rows.append((100 - i, " ".join(words)))
    rows += [(200, None), (150, ""), (151, " \n"), (7, "one two"), (8, "ONE two"), (100, rows[0][1]), (None, base[0]), (9, "q " * 100_000)]
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    fps = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    want = components_of(sorted(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 3)
    assert len(got) == len(rows)
    for x in got:
        if x["doc_id"] is not None:
            assert x["fp"] & (1 << 64) - 1 == fps[x["doc_id"]] and x["component_id"] == want[x["doc_id"]]
    assert want[200] == 150 and want[8] == 7
    kept = simhash.one_of_each_group(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted(x["doc_id"] for x in kept.where("doc_id is not null").collect()) == sorted(set(want.values()))
    assert kept.where("doc_id is null").count() == 1
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    assert simhash.one_of_each_group(docs_of(spark, [(5, "x y"), (5, "x y"), (6, "other words here")])).count() == 2


def brute_force_similar(rows, similarity=0.8, shingle=5):
    sets = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        sets[i] = {b" ".join(words[j : j + shingle]) for j in range(max(1, len(words) - shingle + 1))} if words else set()
    return components_of(sorted(sets), lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) > 0)


@pytest.mark.parametrize("key_part, few, sample", [(1024, 8, 64), (5, 1, 1), (1024, 64, 64), (7, 3, 1)])
def test_similar_documents_go(spark, monkeypatch, key_part, few, sample):
    monkeypatch.setattr(simhash, "COMMON_SAMPLE", sample)
    monkeypatch.setattr(simhash, "COMMON_LEAST", 20)
    r = random.Random(8)
    make = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    line, rows = " ".join(make(12)), []
    for base in (make(n) for n in (200, 200, 60, 30, 12, 4)):
        for _ in range(14):
            words = list(base)
            for _ in range(r.choice((0, 1, 1, 2, 4))):
                words[r.randrange(len(words))] = "changed"
            rows.append((500 - len(rows), " ".join(words)))
    rows += [(10 + i, line + " " + " ".join(make(r.randrange(3, 60)))) for i in range(30)]
    rows += [(600, None), (601, " "), (602, rows[0][1].upper()), (602, rows[0][1])]
    want = brute_force_similar(dict(rows).items())
    kept = simhash.one_of_each_similar(docs_of(spark, [*rows, (None, "no id")]), few=few, key_part=key_part)
    assert sorted(x["doc_id"] for x in kept.where("doc_id is not null").collect()) == sorted(set(want.values()))
    assert kept.columns == docs_of(spark, []).columns and kept.where("doc_id is null").count() == 1
    assert simhash.one_of_each_similar(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("held", [1 << 21, 50])
def test_common_shingles_are_counted_over_all_documents(spark, monkeypatch, held):
    monkeypatch.setattr(simhash, "COMMON_SAMPLE", 2)
    monkeypatch.setattr(simhash, "COMMON_LEAST", 20)
    monkeypatch.setattr(simhash, "COUNT_HELD", held)
    r = random.Random(21)
    make = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    lines = [make(9) for _ in range(6)]
    rows = [(i, " ".join([line for k, line in enumerate(lines) if i % 80 < 37 + k] + [make(3), lines[0] if i % 3 else ""])) for i in range(80)] + [(80, None), (81, " "), (82, "x")]
    counts = Counter(h for _, t in rows for h in np.unique(simhash.shingle_hashes(t, 5)).tolist())
    want = sorted(h for h, n in counts.items() if n >= 40)
    assert 0 < len(want) < len([h for h, n in counts.items() if n > 30])
    assert simhash.common_shingles(docs_of(spark, rows)).tolist() == want
    assert simhash.common_shingles(docs_of(spark, [])).tolist() == []


def test_pipeline_takes_five_words_and_four_fifths(spark):
    import corpus_pipeline

    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    rows = [(1, " ".join(words))] + [(2 + i, " ".join(w if k % 60 != 3 * i + 1 else "changed" for k, w in enumerate(words))) for i in range(20)]
    assert [x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, docs_of(spark, rows), "").collect()] == [1]


@pytest.mark.parametrize("home_part", [1024, 2])
def test_pipeline_removes_near_fingerprints(spark, home_part):
    import corpus_pipeline

    r = random.Random(14)
    make = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows = [(k * 10 + i, (passage + " ") * 60 + make(60)) for k, passage in enumerate(make(21) for _ in range(6)) for i in range(8)]  # few shingles in common, near prints
    rows += [(100 + i, make(80)) for i in range(20)] + [(200 + i, rows[i][1].replace(" ", "  ", 3)) for i in (0, 2, 47)] + [(300, None), (301, "")]
    words = make(200).split()
    rows += [(400, " ".join(words))] + [(401 + i, " ".join(w if k % 60 != 3 * i + 1 else "changed" for k, w in enumerate(words))) for i in range(5)]
    prints, alike = {i: simhash.fingerprint(t) for i, t in rows}, brute_force_similar(rows)
    near = components_of(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    want = components_of(sorted(prints), lambda a, b: near[a] == near[b] or alike[a] == alike[b])
    assert len(set(want.values())) < min(len(set(near.values())), len(set(alike.values())))
    got = simhash.one_of_each_near(docs_of(spark, rows), home_part=home_part) if home_part < 1024 else corpus_pipeline.drop_near_duplicates(spark, docs_of(spark, rows), "")
    assert sorted(x["doc_id"] for x in got.collect()) == sorted(set(want.values()))


# --- packing -------------------------------------------------------------------------------------------------------


def test_best_fit_is_best_fit():
    r = np.random.default_rng(7)
    sizes = r.integers(1, 101, 400)
    where, offset, bins = packing.best_fit(sizes, 100)
    free: list[int] = []
    for item in np.argsort(-sizes, kind="stable"):
        fits = [f for f in free if f >= sizes[item]]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - sizes[item])
        else:
            free.append(100 - sizes[item])
    assert bins == len(free)
    fill = np.bincount(where, weights=sizes)
    assert fill.max() <= 100 and sorted((100 - fill).astype(int)) == sorted(free)


@pytest.mark.parametrize("capacity, chunk, fan_in", [(1024, 100_000, 8), (32, 100_000, 2), (32, 7, 2)])
def test_packing_rows(spark, capacity, chunk, fan_in):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randrange(0, 90)))) for i in range(120)] + [(500, None), (501, ""), (502, "word " * 3000), (503, "x"), (503, "x"), (None, "null id")]
    pieces = packing.materialize(packing.cut_documents(docs_of(spark, rows), VOCABULARY, capacity), "pieces")
    got = packing.pack_pieces(pieces, capacity, slack=1, fan_in=fan_in, chunk=chunk).collect()
    tokens, by_sequence, by_doc = {}, {}, {}
    for i, t in rows:
        tokens[i] = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2]
    for x in got:
        part = tokens[x["doc_id"]][x["start"] : x["start"] + x["length"]]
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == x["ids_crc32"] and len(part) == x["length"]
        by_sequence.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
        by_doc.setdefault(x["doc_id"], []).append((x["piece"], x["start"], x["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for i, parts in by_doc.items():
        parts = sorted(set(parts))
        assert [p for p, _, _ in parts] == list(range(len(parts))) and sum(n for _, _, n in parts) == len(tokens[i])
        assert all(n == capacity for _, _, n in parts[1:])
    assert len(got) == sum(-(-len(tokens[i]) // capacity) for i, _ in rows)
    total = sum(n for places in by_sequence.values() for _, n in places)
    assert len(by_sequence) <= 1.15 * total / capacity + 3
    assert packing.pack_documents(docs_of(spark, []), VOCABULARY).count() == 0


# --- repeated strings ----------------------------------------------------------------------------------------------


def plain_repeats(rows, length):
    first, out = {}, {}
    for d, t in sorted(rows):
        data = (t or "").encode()
        covered = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if first.setdefault(w, (d, i)) < (d, i):
                covered[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(data, covered) if not c)
        runs = sum(1 for i in range(len(data)) if covered[i] and not (i and covered[i - 1]))
        out[d] = (len(data), sum(covered), runs, hashlib.sha256(kept).hexdigest())
    return out


def repeating_rows(seed=9):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7))) for _ in range(60)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passages, rows = [make(120) for _ in range(10)], [make(30) for _ in range(4)], []
    for i in range(150):
        c = r.random()
        if c < 0.2:
            t = r.choice(base)
        elif c < 0.5:
            w = r.choice(base).split(" ")
            for _ in range(r.randrange(1, 6)):
                w[r.randrange(len(w))] = make(1)
            t = " ".join(w)
        elif c < 0.7:
            t = make(r.randrange(0, 60)) + r.choice(passages) + make(r.randrange(0, 60))
        elif c < 0.8:
            t = r.choice(["a", "ab", "xyz\0"]) * r.randrange(0, 500)
        elif c < 0.85:
            t = None
        else:
            t = (make(40) + " ") * 3
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("length, options", [(100, {}), (100, {"crowd": 3}), (20, {"crowd": 8, "shard_bytes": 2000}), (33, {"shard_bytes": 500}), (100, {"crowded_bytes": 100}), (20, {"crowd": 4, "crowded_bytes": 400})])
def test_repeats_equal_brute_force(spark, length, options):
    rows = repeating_rows()
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeat_digests(docs_of(spark, rows), length, **options).collect()}
    assert got == plain_repeats(rows, length)


def test_repeats_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 64)
    rolling = suffix_dedup._Rolling()
    data = np.frombuffer(("abcdefghij" * 60 + "z").encode(), dtype=np.uint8)
    _, _, _, start, count, _ = suffix_dedup.runs_of(data, 100, rolling)
    assert start[0] == 0 and (start[1:] == start[:-1] + count[:-1]).all() and start[-1] + count[-1] == len(data) - 99


def test_spans_that_collide_in_the_rolling_hash_are_no_repeats(spark):
    """Two texts whose blocks end in the Thue-Morse word and in its complement: equal in any polynomial hash modulo 2**64, and no window twice."""
    rolling, rng = suffix_dedup._Rolling(), np.random.default_rng(3)
    rolling.reach(36)
    low, x = None, b""
    for _ in range(20):
        grams = rng.integers(97, 123, size=(100_000, 36)).astype(np.uint8)
        prefix = np.zeros((len(grams), 37), dtype=np.uint64)
        np.cumsum((grams.astype(np.uint64) + np.uint64(1)) * rolling.up[:36], axis=1, out=prefix[:, 1:])
        h = rolling.between(prefix.T, np.zeros(1, dtype=np.int64), np.full(1, 36))[0]
        if low is None or h.min() < low:
            low, x = h.min(), grams[int(h.argmin())].tobytes()
    x, r = x.decode(), random.Random(5)
    noise = [f"{r.getrandbits(32):08x}" for _ in range(1024)]
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    rows = [(1, "".join(x + n + str(b) for n, b in zip(noise, bits))), (2, "".join(x + n + str(1 - b) for n, b in zip(noise, bits)))]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeat_digests(docs_of(spark, rows)).collect()}
    assert got == plain_repeats(rows, 100) and got[2][1] == 0


def test_repeats_of_odd_rows(spark):
    long = "".join(random.Random(10).choices("ab ", k=300_000))
    rows = [(1, long), (2, long), (3, "short"), (4, None), (5, "q" * 50_000), (6, "é" * 300)]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeat_digests(docs_of(spark, rows)).collect()}
    assert got[2][1] == 300_000 and got[1][1] == 0 and got[4] == (0, 0, 0, hashlib.sha256(b"").hexdigest())
    assert got[5] == (50_000, 49_999, 1, hashlib.sha256(b"q").hexdigest())
    again = suffix_dedup.repeat_digests(docs_of(spark, [(1, long[:500]), (1, long[:500]), (None, long[:500])])).collect()
    assert [r["n_removed"] for r in again] == [0, 0, 0]
    assert suffix_dedup.repeat_digests(docs_of(spark, [])).count() == 0


def test_without_repeats_keeps_columns(spark):
    rows = repeating_rows(11)
    df = docs_of(spark, rows).withColumn("n_chars", F.length("text"))
    out = suffix_dedup.without_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    want = plain_repeats(rows, 100)
    for r in out.collect():
        if want[r["doc_id"]][1] == 0:
            assert r["text"] == (dict(rows)[r["doc_id"]] or "")
        assert r["n_chars"] == len(r["text"]) and len(r["text"].encode()) <= want[r["doc_id"]][0] - want[r["doc_id"]][1]


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(12)
    text = np.concatenate([r.integers(97, 100, 300), np.full(150, 97), r.integers(97, 99, 200)]).astype(np.uint8)
    data = text.tobytes()
    words = suffix_dedup._words(text, 48)
    order, group, reached = suffix_dedup.suffix_array(words, len(text), 32)
    padded = data + b"\0" * 64
    keys = [padded[i : i + reached] for i in order]
    assert keys == sorted(keys) and reached >= 32
    prefix = suffix_dedup.common_prefixes(words, order, group, 32, lanes=7)
    for k in range(1, len(order)):
        a, b = padded[order[k - 1] : order[k - 1] + 32], padded[order[k] : order[k] + 32]
        assert prefix[k] == next((i for i in range(32) if a[i] != b[i]), 32)


# --- toxicity ------------------------------------------------------------------------------------------------------


def toxic_rows(seed=13, n=400):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghilmnorst") for _ in range(r.randrange(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(r.choice(words) for _ in range(8)) for _ in range(r.randrange(1, 12))]
        bad = i % 4 == 0
        if bad:
            k = r.randrange(len(sentences))
            sentences[k] += f" vile{r.choice(['ous', 'ness', 'ly', 'st'])} fiend"
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_learns_and_locates(spark):
    rows, labels = toxic_rows()
    df = docs_of(spark, [*rows, (9001, None), (9002, ""), (9003, "viledom fiend. " + "clean words here. " * 20_000), (None, "nothing")])
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (0, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, marks, toxicity.in_training_folds)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    truth = dict(labels)
    wrong = [i for i in truth if got[i]["predicted"] != truth[i]]
    assert len(wrong) <= 4
    assert got[9001]["score"] == got[9002]["score"] == 0 and got[9001]["worst_start"] is None
    assert got[9003]["predicted"] == 1 and all(0 <= r["score"] <= 1 for r in got.values())
    text = dict(rows)
    found = [r for r in toxicity.offending_sentences(df, model).collect() if r["doc_id"] in truth]
    assert all("fiend" in r["sentence"] and text[r["doc_id"]][r["start"] : r["end"]] == r["sentence"] for r in found)
    clean = toxicity.without_toxic(df, model)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_toxicity_score_is_noisy_or():
    scorer = toxicity.ToxicityModel({"bad": 3.0, "vile-": 2.0}, -2.0).scorer()
    p = [1 / (1 + np.exp(2.0)), 1 / (1 + np.exp(-1.0)), 1 / (1 + np.exp(-0.0))]
    score, n, worst = scorer.document("fine words. so BAD! vileness\n...")
    assert n == 3 and score == pytest.approx(1 - np.prod([1 - x for x in p])) and worst[0] == 11


def test_toxicity_of_long_clean_documents(spark):
    rows, labels = toxic_rows(n=600)
    marks = [(i, int(y or i % 10 == 1)) for i, y in labels]  # a tenth is called toxic without an offending word
    clean = [" ".join(text.split()[:8]).replace(".", "") for i, text in rows if not labels[i][1]]
    long = ". ".join(clean[k % len(clean)] for k in range(100_000))
    df = docs_of(spark, [*rows, (9001, long), (9002, long + ". such vileness of a fiend")])
    model = toxicity.fit(df, spark.createDataFrame(marks, "doc_id long, toxic int"), toxicity.in_training_folds)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert got[9001]["n_sentences"] == 100_000 and not got[9001]["predicted"] and got[9002]["predicted"]
    assert sum(got[i]["predicted"] != y for i, y in labels) <= 6


def test_toxicity_without_labels(spark):
    rows, _ = toxic_rows(n=20)
    df = docs_of(spark, rows)
    for marks in ([], [(1, 1), (2, 1)], [(1, 0)]):
        model = toxicity.fit(df, spark.createDataFrame(marks, "doc_id long, toxic int"), toxicity.in_training_folds)
        assert toxicity.score(df, model).where("predicted = 1").count() == 0
    assert toxicity.score(df.limit(0), model).count() == 0


def test_toxicity_on_held_out_rows(spark):
    """Fit on two thirds, judge the rest: a marked sentence somewhere in a toxic document, some labels wrong, clean texts of any length left alone."""
    r = random.Random(11)
    plain = ["".join(r.choice("abcdefghijklm") for _ in range(r.randrange(2, 8))) for _ in range(800)]
    marked = ["grobbly", "snarfen", "viktuous", "plonkard"]
    rows, labels, truth = [], [], {}
    for i in range(1500):
        sentences = [" ".join(r.choices(plain, k=r.randrange(3, 12))) for _ in range(r.randrange(1, 30))]
        truth[i] = r.random() < 0.2
        if truth[i]:
            at = r.randrange(len(sentences))
            sentences[at] += " " + r.choice(marked) + r.choice(["", "s", "ing"])
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(truth[i] != (r.random() < 0.03))))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known, toxicity.in_training_folds)
    got = {x["doc_id"]: x["predicted"] for x in toxicity.score(docs, model).collect()}
    unseen = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    found = sum(got[i] for i in unseen if truth[i]) / sum(truth[i] for i in unseen)
    wrong = sum(got[i] for i in unseen if not truth[i]) / sum(not truth[i] for i in unseen)
    assert found >= 0.95 and wrong <= 0.01
    long = ". ".join(" ".join(r.choices(plain, k=8)) for _ in range(100_000))
    assert model.scorer().document(long)[0] < toxicity.ACCEPT


def test_toxicity_of_long_clean_texts(spark):
    """Sentences of sf0.1's clean documents stay clean as texts of up to 100,000 of them, and one offending sentence among them is found."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels, toxicity.in_training_folds)
    scorer, r = model.scorer(), random.Random(4)
    rows = docs.join(labels, "doc_id").select("text", "toxic").collect()
    clean = [x["text"] for x in rows if x["toxic"] == 0 and scorer.document(x["text"])[0] < toxicity.ACCEPT]
    lines = [line for text in clean for line in text.split("\n") if line.strip()]
    for n in (100, 10_000, 30_000, len(lines)):
        text = "\n".join(r.sample(lines, min(n, len(lines))))
        score, sentences, _ = scorer.document(text)
        assert score < 0.2, (n, sentences, score)
        offender = max((s for x in rows if x["toxic"] == 1 for s in [scorer.document(x["text"])[2]] if s), key=lambda s: s[2])
        assert sentences > n / 2 and offender[2] > 1
    worst = next(x["text"] for x in rows if x["toxic"] == 1 and (scorer.document(x["text"])[2] or (0, 0, 0))[2] > 1.5)
    a, b, _ = scorer.document(worst)[2]
    assert scorer.document(text + "\n" + worst[a:b] + ".")[0] >= toxicity.ACCEPT


def test_toxicity_fit_is_a_minimum_of_the_plain_likelihood():
    """The weights of Adam against the noisy-or likelihood written out: no step along any weight lowers it."""
    rng = np.random.default_rng(3)
    bags = [([[int(k) for k in rng.choice(6, rng.integers(1, 3), replace=False)] for _ in range(rng.integers(1, 5))]) for _ in range(120)]
    labels = np.array([int(any(0 in s or 1 in s for s in b)) if rng.random() > 0.1 else int(rng.integers(2)) for b in bags])
    row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    sizes = [len(s) for b in bags for s in b]
    packed = (labels, row, np.repeat(np.arange(len(row)), sizes), np.array([k for b in bags for s in b for k in s]))
    class_weight = {0: 2.0, 1: 1.0}
    weights, bias, leak = toxicity._fit_weights(packed, 6, class_weight, steps=4000, rate=0.02)

    def loss(w):
        total, mass = 0.0, 0.0
        for bag, y in zip(bags, labels):
            clean = leak + sum(math.log1p(math.exp(bias + sum(w[k] for k in s))) - math.log1p(math.exp(bias)) for s in bag)
            total -= class_weight[y] * (math.log(-math.expm1(-clean)) if y else -clean)
            mass += class_weight[y]
        return total / mass + 0.5e-5 * float(w @ w)

    best = loss(weights)
    for k in range(6):
        for step in (-0.05, 0.05):
            moved = weights.copy()
            moved[k] = max(0.0, moved[k] + step)
            assert loss(moved) >= best - 1e-6
    assert min(weights[0], weights[1]) > 2 * max(weights[2:])
