"""Phrase collocation mining by generalised suffix automata of shards.

A shard is a stretch of a task's words (about ``SHARD_WORDS``).  Its automaton holds, for every contiguous run of up to ``max_words``
words of a piece, the state of that run: runs that end at the same places are one state, known by its longest run, its
shortest, the size of its set of end places and a suffix link to the state of the next shorter run.  It is built by levels in numpy, since nothing deeper
than ``max_words`` is asked of it.

1.  Shards deal 64-bit hashes of their runs, with counts, by the hashes' first bits; a hash that occurs ``least`` times in all survives.
2.  The survivors make a bitmap of bounded size.  Shards are built again and give the text and count of runs that it lets pass, and equal texts are summed: these
    counts are exact, since hashes (and a full bitmap) only ever let too much pass.
3.  Scores, subsumption and ranks are joins and aggregates over the phrases that are left.  What a longer candidate covers goes down
    its suffix link, and that of its reverse (the phrase without its last word), level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, heavy_keys, materialize, release_memory, shuffle_width, spread_join

MAX_WORDS = 3
LEAST = 10
COVERED = 50
TOP = 2000
NO_LANGUAGE = "und"
#: Words of a shard; bytes of a text taken apart at a time.
SHARD_WORDS = 1 << 20
STRETCH = 8 << 20
#: Bits of the bitmap for each survivor, and its size at least and at most (128 MB), as powers of two.
BITS_EACH = 16
LEAST_BITS, MOST_BITS = 20, 30
_BREAK = 10
_TABLE = bytes(_BREAK if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


class _Numbers(dict):
    """Numbers of words: breaks are 0, the empty string between two spaces is -1."""

    def __init__(self):
        super().__init__({b"": -1, b"\n": 0})
        self.words = [b"\n"]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


def numbered(text: str, numbers: _Numbers) -> Iterator[np.ndarray]:
    """The words of a text as numbers, a 0 at each break, a stretch at a time; a stretch ends between words and breaks nothing."""
    data = text.encode("utf-8").translate(_TABLE)
    at = 0
    while at < len(data):
        end = at + STRETCH
        if end < len(data):
            cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
            if cut < at:
                cut = min((x for x in (data.find(b" ", end), data.find(b"\n", end)) if x >= 0), default=len(data) - 1)
            end = cut + 1
        tokens = data[at:end].replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(numbers.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        yield ids[ids >= 0]
        at = end


@dataclass
class Automaton:
    """States of a shard's runs of words: an occurrence of the longest run (``place``, ``longest`` words), the ``shortest`` run that ends wherever it
    does, how many places those are, and the state of the next shorter run (-1: none)."""

    place: np.ndarray
    longest: np.ndarray
    shortest: np.ndarray
    ends: np.ndarray
    link: np.ndarray

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every distinct run once: place, words, occurrences."""
        found = []
        for words in range(1, int(self.longest.max(initial=0)) + 1):
            has = (self.shortest <= words) & (words <= self.longest)
            found.append((self.place[has] + self.longest[has] - words, np.full(int(has.sum()), words), self.ends[has]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3  # type: ignore[return-value]


def _ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of whole numbers, and the numbers in it; number and place are sorted as one where they fit in 63 bits, which is several times as fast."""
    bits = len(key).bit_length()
    if int(key.max(initial=0)).bit_length() + bits > 63:
        order = np.argsort(key)
        return order, key[order]
    packed = np.sort((key << bits) | np.arange(len(key)))
    return packed & ((1 << bits) - 1), packed >> bits


def suffix_automaton(words: np.ndarray, depth: int) -> Automaton:
    """The automaton of numbered words with 0 between pieces, for runs of up to ``depth`` words."""
    n = len(words)
    width = np.int64(words.max(initial=0)) + 1
    here = np.full(n, -1, dtype=np.int64)  # the node of the run of so many words that begins at a place
    place, level, ends, shorter = [], [], [], []
    total = 0
    for k in range(1, depth + 1):
        before = here
        if k == 1:
            at = np.flatnonzero(words > 0)
            key = words[at].astype(np.int64)
        else:
            at = np.flatnonzero((before[: max(n - k + 1, 0)] >= 0) & (words[k - 1 :] > 0))
            key = before[at] * width + words[at + k - 1]
        if not len(at):
            break
        order, ranked = _ordered(key)
        new = np.append(True, ranked[1:] != ranked[:-1])
        head = np.flatnonzero(new)
        here = np.full(n, -1, dtype=np.int64)
        here[at[order]] = total + np.cumsum(new) - 1
        place.append(at[order[head]])
        level.append(np.full(len(head), k, dtype=np.int64))
        ends.append(np.diff(np.append(head, len(at))))
        shorter.append(before[place[-1] + 1] if k > 1 else np.full(len(head), -1, dtype=np.int64))
        total += len(head)
    if not total:
        return Automaton(*(np.empty(0, np.int64) for _ in range(5)))
    place, level, ends, shorter = (np.concatenate(x) for x in (place, level, ends, shorter))
    # A run that always ends where a longer one does is of that one's state.
    joins = np.flatnonzero((shorter >= 0) & (ends == ends[np.maximum(shorter, 0)]))
    into = np.arange(total)
    into[shorter[joins]] = joins
    lowest = np.arange(total)  # the shortest run of a state, by levels upwards
    for k in range(2, depth + 1):
        up = joins[level[joins] == k]
        lowest[up] = lowest[shorter[up]]
    for _ in range(depth - 1):
        into = into[into]
    states = np.flatnonzero(into == np.arange(total))
    name = np.full(total, -1, dtype=np.int64)
    name[states] = np.arange(len(states))
    link = shorter[lowest[states]]
    return Automaton(place[states], level[states], level[lowest[states]], ends[states], np.where(link >= 0, name[into[np.maximum(link, 0)]], -1))


def _hashes(lang: str, words: np.ndarray, of_word: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    h = np.full(len(place), xxhash.xxh64_intdigest(lang.encode(), 7), dtype=np.uint64)
    for k in range(int(length.max(initial=0))):
        on = length > k
        x = (h[on] ^ of_word[words[place[on] + k]]) * _ODD[0]
        x ^= x >> np.uint64(29)
        h[on] = x * _ODD[1]
        h[on] ^= h[on] >> np.uint64(32)
    return h


def _shards(batches: Iterator[pa.RecordBatch], depth: int, shard_words: int):
    """Of each shard and language: the language, its numbered words, the words, their hashes, and the runs of its automaton."""
    numbers, streams, held = _Numbers(), {}, 0

    def build():
        of_word = np.fromiter((xxhash.xxh64_intdigest(w, 3) for w in numbers.words), dtype=np.uint64, count=len(numbers.words))
        for lang, parts in streams.items():
            words = np.concatenate(parts)
            yield lang, words, numbers.words, of_word, suffix_automaton(words, depth).runs()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            stream = streams.setdefault(lang, [np.zeros(1, dtype=np.int32)])
            for ids in numbered(text.as_py() or "", numbers):
                stream.append(ids)
                held += len(ids)
            stream.append(np.zeros(1, dtype=np.int32))
            if held >= shard_words:
                yield from build()
                numbers, streams, held = _Numbers(), {}, 0
    yield from build()


def _deal_hashes(batches: Iterator[pa.RecordBatch], depth: int, shard_words: int, bits: int) -> Iterator[pa.RecordBatch]:
    release_memory()
    for lang, words, _, of_word, (place, length, n) in _shards(batches, depth, shard_words):
        h = _hashes(lang, words, of_word, place, length)
        group = (h >> np.uint64(64 - bits)).astype(np.uint16)
        order = np.argsort(group, kind="stable")
        h, n, group = h[order], n[order].astype("u4"), group[order]
        cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(h) else np.empty(0, np.int64)
        ends = np.append(cuts[1:], len(h))
        for a in range(0, len(cuts), 64):
            some = list(zip(cuts[a : a + 64].tolist(), ends[a : a + 64].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([int(group[x]) for x, _ in some], pa.int32()), pa.array([h[x:y].tobytes() + n[x:y].tobytes() for x, y in some], pa.binary())], ["group", "hashes"])
    release_memory()


def _survivors(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows ordered by group: hashes whose counts sum to ``least`` or more."""

    def sift(group: int, blobs: list[bytes]) -> pa.RecordBatch:
        sizes = [len(b) // 12 for b in blobs]
        h = np.concatenate([np.frombuffer(b, dtype="u8", count=s) for b, s in zip(blobs, sizes)])
        n = np.concatenate([np.frombuffer(b, dtype="u4", offset=8 * s) for b, s in zip(blobs, sizes)])
        order = np.argsort(h)
        h, n = h[order], n[order].astype(np.int64)
        head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        left = h[head[np.add.reduceat(n, head) >= least]]
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([len(left)], pa.int64()), pa.array([left.tobytes()], pa.binary())], ["group", "n", "hashes"])

    last, held = None, []
    for batch in batches:
        for group, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if group != last and held:
                yield sift(last, held)
                held = []
            last = group
            held.append(blob.as_py())
    if held:
        yield sift(last, held)
    held.clear()
    release_memory()


def _segments(batches: Iterator[pa.RecordBatch], bits: int, group_bits: int) -> Iterator[pa.RecordBatch]:
    """The stretch of the bitmap that each group's survivors set; a group's hashes share their first bits."""
    size = 1 << (bits - group_bits)
    for batch in batches:
        for group, blob in zip(batch.column(0).to_pylist(), batch.column(2)):
            own = np.zeros(size, dtype=bool)
            own[((np.frombuffer(blob.as_py(), dtype="u8") >> np.uint64(64 - bits)) & np.uint64(size - 1)).astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["group", "bits"])


def _name_runs(batches: Iterator[pa.RecordBatch], depth: int, shard_words: int, bits: int, bitmap, rows: int = 16384) -> Iterator[pa.RecordBatch]:
    """Texts and counts of the runs that the bitmap lets pass; and a row of no words with the number of words."""
    release_memory()
    names = ["lang", "words", "phrase", "n"]
    passing = np.frombuffer(bitmap.value, dtype=np.uint8)
    for lang, words, spelled, of_word, (place, length, n) in _shards(batches, depth, shard_words):
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([int((words > 0).sum())], pa.int64())], names)
        at = _hashes(lang, words, of_word, place, length) >> np.uint64(64 - bits)
        kept = np.flatnonzero((passing[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
        for a in range(0, len(kept), rows):
            p, k, c = (x[kept[a : a + rows]] for x in (place, length, n))
            texts = [b" ".join([spelled[w] for w in words[i : i + m].tolist()]) for i, m in zip(p.tolist(), k.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(p), pa.string()), pa.array(k, pa.int32()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(c, pa.int64())], names)
    release_memory()


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, shard_words: int = SHARD_WORDS, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, words, phrase, n: every phrase of 1 to ``max_words`` words that occurs ``least`` times or more in its language, with its occurrences;
    and for each language a row of 0 words whose n is the number of all its words.  A written table."""
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), "text")
    group_bits = min(16, max(4, (shuffle_width(spark) - 1).bit_length()))
    dealt = source.mapInArrow(partial(_deal_hashes, depth=max_words, shard_words=shard_words, bits=group_bits), "group int, hashes binary")
    left = materialize(dealt.repartitionById(1 << group_bits, F.col("group")).sortWithinPartitions("group").mapInArrow(partial(_survivors, least=least), "group int, n long, hashes binary"), "survivors")
    survivors = left.agg(F.sum("n")).collect()[0][0] or 0
    bits = max(group_bits + 3, LEAST_BITS, min(most_bits, (BITS_EACH * survivors).bit_length()))
    segments = left.mapInArrow(partial(_segments, bits=bits, group_bits=group_bits), "group int, bits binary").toArrow()  # at most 2 ** most_bits bits
    size = 1 << (bits - group_bits - 3)
    whole = bytearray(size << group_bits)
    for group, some in zip(segments.column(0).to_pylist(), segments.column(1)):
        whole[group * size : (group + 1) * size] = some.as_py()
    del segments
    discard(left)
    bitmap = spark.sparkContext.broadcast(bytes(whole))
    named = source.mapInArrow(partial(_name_runs, depth=max_words, shard_words=shard_words, bits=bits, bitmap=bitmap), "lang string, words int, phrase string, n long")
    return materialize(named.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("words") == 0)), "phrases")


def _with_count(rows: DataFrame, counts: DataFrame, phrase: str, name: str, total: int) -> DataFrame:
    """``rows`` with the count of ``phrase``; a word that a large share of the phrases begin or end with is dealt over salts."""
    key = ["lang", phrase]
    heavy = heavy_keys(rows.groupBy(*key).agg(F.count("*").alias("_n")), "_n", total)
    right = counts.select("lang", F.col("phrase").alias(phrase), F.col("n").alias(name))
    return spread_join(rows, right, key, heavy, F.xxhash64("phrase"), "inner")


def score_candidates(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score: phrases of two words and more by their lowest-scoring cut.

    Scores are quotients of decimals of 38 digits, so they are exact up to a = 10 ** 16.
    """
    phrases = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    parts = counts.where("words > 0")
    total = cuts.count()
    cuts = _with_count(_with_count(cuts, parts, "first", "l", total), parts, "rest", "r", total)
    exact = {c: f"cast({c} as decimal(19, 0))" for c in "alr"}
    cuts = cuts.withColumn("score", F.expr(f"cast((1000000bd * ({exact['a']} * {exact['a']})) div ({exact['l']} * {exact['r']}) as bigint)"))
    lowest = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_c"))
    return lowest.select("lang", "phrase", "words", "a", "_c.l", "_c.r", "_c.score")


def not_covered(scored: DataFrame, covered: int = COVERED, max_words: int = MAX_WORDS) -> DataFrame:
    """Candidates without those whose words lie inside a longer one that occurs ``covered`` hundredths as often or more.

    From the longest down, a candidate hands its count, or the greatest handed to it, to the phrases without its first and without its last word.
    """
    levels, handed = [], None
    for k in range(max_words, 1, -1):
        level = scored.where(F.col("words") == k)
        level = level.withColumn("_inside", F.lit(None).cast("long")) if handed is None else level.join(handed, ["lang", "phrase"], "left")
        levels.append(level.where(F.col("_inside").isNull() | (100 * F.col("_inside") < covered * F.col("a"))).drop("_inside"))
        most = level.select("lang", F.greatest("a", "_inside").alias("_inside"), F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)").alias("_tail"), F.expr("substring_index(phrase, ' ', words - 1)").alias("_head"))
        handed = most.select("lang", F.explode(F.array("_tail", "_head")).alias("phrase"), "_inside").groupBy("lang", "phrase").agg(F.max("_inside").alias("_inside"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, covered: int = COVERED, top: int = TOP, shard_words: int = SHARD_WORDS, most_bits: int = MOST_BITS) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has text and lang; other columns are not read.  A null text is empty, a null lang is ``und``; rows that repeat are texts of their own.  Texts of any
    length are read whole, a stretch at a time.  Equal scores go by a, then by the phrase's bytes.  A language without candidates has no row, and an empty table gives an
    empty result.
    """
    counts = phrase_counts(docs, max_words, least, shard_words, most_bits)
    scored = materialize(score_candidates(counts), "scored")
    kept = not_covered(scored, covered, max_words)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    within = Window.partitionBy("lang", "_salt").orderBy(*order)  # a language's phrases are ranked in parts before they are ranked together
    some = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(shuffle_width(docs.sparkSession)))).withColumn("_r", F.row_number().over(within)).where(F.col("_r") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
