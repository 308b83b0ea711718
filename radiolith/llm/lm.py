"""Language-model scoring: a gated recurrent model with class-factored output, in numpy, over exact corpus counts.

Counting.  Words of training documents are counted over the whole corpus.  The commonest (at most ``LEXICON``) go to every
task; the rest stay a table, with which the rare words of documents are joined.

Model.  The commonest ``VOCABULARY`` tokens, in classes of ``CLASS_SIZE`` by frequency, are predicted as class, then word in the
class.  Every other word belongs to one of ``RARE_CLASSES`` by its first letters and has, within that class,
probability (c + 1) / (tokens + types + 1), so the model is a distribution over all words with one unseen type a class.

Training.  Truncated backpropagation over windows of ``WINDOW`` tokens, the state carried from window to window, with
documents as lanes.  Training documents are dealt by hash to as many tasks as a round's tokens ask for (``TASK_TOKENS``), each trains on all of its
own in the order of their hash, and the tasks' parameters are averaged up a tree; a first round over a hash share of the documents gives all tasks a
common start for the second, over the rest.  Every training document is used once, and how the table lies in files has no part in the model.

Scoring.  The state is carried over the whole document, so the score is the log-likelihood of the complete text.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, discard, materialize, release_memory, remainder_of_crc32

LEXICON = 262_144
VOCABULARY = 512
CLASS_SIZE = 32
RARE_CLASSES = 32
HIDDEN = 16
WINDOW = 32
LANES = 256
#: Tokens that a task lays out in lanes at a time.
GROUP_TOKENS = 4 << 20
#: Tokens of the corpus for each training task.
TASK_TOKENS = 2 << 20
SCORE_TOKENS = 2 << 20
RATE = 0.01
FIRST_SHARE = 8  # one document in so many trains in the first round, the rest in the second
FAN_IN = 64
SEED = 11
END = b""


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch's texts with A-Z in lower case, in order, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = parts.flatten()
    filled = np.asarray(pc.binary_length(words)) > 0  # white space at either end leaves an empty part
    sums = np.append(0, np.cumsum(filled))
    bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    return words.filter(pa.array(filled)), np.diff(sums[bounds])


def rare_class(word: bytes, classes: int = RARE_CLASSES) -> int:
    return zlib.crc32(word.decode("utf-8", "ignore")[:2].encode("utf-8")) % classes


def rare_classes(words: pa.Array) -> np.ndarray:
    """The rare class of each word; only different beginnings are hashed one by one."""
    heads = pc.utf8_slice_codeunits(words, 0, 2).dictionary_encode()
    classes = np.array([rare_class(x.encode("utf-8")) for x in heads.dictionary.to_pylist()], dtype=np.int32)
    return classes[heads.indices.to_numpy()]


# --- corpus counts -------------------------------------------------------------------------------------------------


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` (binary; the empty word is the end of a document) and ``c`` over all rows of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.Table] = []
        size = ends = 0

        def summed() -> pa.Table:
            return pa.concat_tables(seen).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

        for batch in batches:
            found = pc.value_counts(words_of(batch.column(0))[0])
            seen.append(pa.table({"word": found.field("values").cast(pa.binary()), "c": found.field("counts")}))
            size += len(found)
            ends += len(batch)
            if size > 800_000:
                seen = [summed()]
                size = len(seen[0])
                if size > 400_000:
                    yield from seen.pop().to_batches()
                    size = 0
        if seen:
            yield from summed().to_batches()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], ["word", "c"])

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """What every task knows of the counts: the commonest words with counts, totals, and totals of rare classes."""

    def __init__(self, words: list[bytes], counts: np.ndarray, tokens: int, types: int, vocabulary: int = VOCABULARY):
        order = sorted(range(len(words)), key=lambda i: (-int(counts[i]), words[i]))
        self.words = [words[i] for i in order]
        self.counts = counts[order].astype(np.int64) if len(words) else np.zeros(0, dtype=np.int64)
        self.tokens, self.types = tokens, types
        known = self.words[:vocabulary]
        if END not in known:  # the end is always a token of the model
            known = [*known[: vocabulary - 1], END]
            rest = [w for w in self.words if w not in set(known)]
            lookup = dict(zip(self.words, self.counts.tolist()))
            self.words = known + rest
            self.counts = np.array([lookup.get(w, 0) for w in self.words], dtype=np.int64)
        self.known = len(known)
        self.classes = -(-vocabulary // CLASS_SIZE)
        self.end = known.index(END)
        self.rare_tokens = np.zeros(RARE_CLASSES)
        self.rare_types = np.zeros(RARE_CLASSES)

    def model_ids(self) -> np.ndarray:
        """Of every word here: its token in the model, or after those its rare class."""
        vocabulary = self.classes * CLASS_SIZE
        return np.array([*range(self.known), *(vocabulary + rare_class(w) for w in self.words[self.known :])], dtype=np.int32)


def build_lexicon(counts: DataFrame, most: int = LEXICON, vocabulary: int = VOCABULARY) -> Lexicon:
    """The lexicon of a table of word counts; at most ``most`` words come to the driver."""
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).collect()[0]
    steps = counts.groupBy(F.floor(F.log2("c") * 8).cast("int").alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()
    taken, bound = 0, None
    for row in steps:
        if taken + row["n"] > most:
            break
        taken, bound = taken + row["n"], row["least"]
    if bound is None and steps:  # more than ``most`` words share the greatest counts: take a part by order
        top = counts.orderBy(F.desc("c"), "word").limit(most).toArrow()
    else:
        top = counts.where(F.col("c") >= (bound or 0)).toArrow()
    out = Lexicon(top.column("word").to_pylist(), top.column("c").to_numpy(), int(tokens), int(types), vocabulary)
    own = pa.array(out.words[: out.known], pa.binary())

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(RARE_CLASSES, dtype=np.int64), np.zeros(RARE_CLASSES, dtype=np.int64)
        for batch in batches:
            rest = batch.filter(pc.invert(pc.is_in(batch.column(0), value_set=own)))
            r = rare_classes(rest.column(0).cast(pa.string()))
            np.add.at(n, r, rest.column(1).to_numpy())
            v += np.bincount(r, minlength=RARE_CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(range(RARE_CLASSES), pa.int32()), pa.array(n), pa.array(v)], ["r", "n", "v"])

    for r, n, v in counts.mapInArrow(total, "r int, n long, v long").groupBy("r").agg(F.sum("n"), F.sum("v")).collect():
        out.rare_tokens[r], out.rare_types[r] = n, v
    return out


# --- the recurrent model -------------------------------------------------------------------------------------------


class Gru:
    """Parameters by name, all float32; states and gates have a row for each unit and a column for each lane, so that every
    gate and every softmax works on contiguous memory.

    ``input`` (token to its share of the gates: update, reset, candidate) and ``state`` (state to gates); ``cls``/``cls_b`` for classes
    (of known tokens, then rare) and ``word``/``word_b`` for the words of each class.
    """

    NAMES = ("input", "state", "cls", "cls_b", "word", "word_b")

    def __init__(self, lexicon: Lexicon, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        h, k, r = hidden, lexicon.classes, RARE_CLASSES
        self.hidden, self.classes = h, k
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.input, self.state = small(3 * h, k * CLASS_SIZE + r), (rng.standard_normal((3 * h, h)) / math.sqrt(h)).astype(np.float32)
        self.cls, self.word = small(k + r, h), small(k, CLASS_SIZE, h)
        # Output biases start at the corpus frequencies.
        c = np.zeros(k * CLASS_SIZE)
        c[: lexicon.known] = lexicon.counts[: lexicon.known]
        word = np.where(np.arange(len(c)) < lexicon.known, c + 0.5, 1e-9).reshape(k, CLASS_SIZE, 1)
        self.word_b = np.log(word / word.sum(axis=1, keepdims=True)).astype(np.float32)
        total = np.concatenate([c.reshape(k, -1).sum(axis=1), lexicon.rare_tokens])[:, None] + 0.5
        self.cls_b = np.log(total / total.sum()).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> Gru:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def step(self, h: np.ndarray, tokens: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The state after ``tokens``."""
        d = self.hidden
        x = np.take(self.input, tokens, axis=1)
        u = self.state @ h
        gates = x[: 2 * d]
        gates += u[: 2 * d]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        m = u[2 * d :]
        n = gates[d:] * m
        n += x[2 * d :]
        np.tanh(n, out=n)
        if keep is not None:
            keep.append((h, gates, n, m))
        out = h - n
        out *= gates[:d]
        out += n
        return out

    def output(self, s: np.ndarray, tokens: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each token (of its class only, if rare) from the states ``s``, and the gradient on ``s``."""
        known = self.classes * CLASS_SIZE
        cls = np.where(tokens < known, tokens // CLASS_SIZE, tokens - known + self.classes).astype(np.int16)
        order = np.argsort(cls, kind="stable")
        s, cls, tokens = np.take(s, order, axis=1), cls[order], tokens[order]
        columns = np.arange(len(cls))
        p = self.cls @ s
        p += self.cls_b
        p -= p.max(axis=0)
        logp = p[cls, columns]
        np.exp(p, out=p)
        total = p.sum(axis=0)
        logp -= np.log(total)
        if grads is not None:
            p /= total
            p[cls, columns] -= 1.0
            grads["cls"], grads["cls_b"], ds = p @ s.T, p.sum(axis=1, keepdims=True), self.cls.T @ p
            grads["word"], grads["word_b"] = np.zeros_like(self.word), np.zeros_like(self.word_b)
        bounds = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        for k in range(self.classes):
            a, b = bounds[k], bounds[k + 1]
            if a == b:
                continue
            own, w, here = s[:, a:b], tokens[a:b] - k * CLASS_SIZE, columns[: b - a]
            q = self.word[k] @ own
            q += self.word_b[k]
            q -= q.max(axis=0)
            logp[a:b] += q[w, here]
            np.exp(q, out=q)
            mass = q.sum(axis=0)
            logp[a:b] -= np.log(mass)
            if grads is not None:
                q /= mass
                q[w, here] -= 1.0
                grads["word"][k], grads["word_b"][k] = q @ own.T, q.sum(axis=1, keepdims=True)
                ds[:, a:b] += self.word[k].T @ q
        back = np.empty(len(order), dtype=np.int64)
        back[order] = columns
        return logp[back], None if grads is None else np.take(ds, back, axis=1)

    def gradients(self, h: np.ndarray, tokens: list[np.ndarray], fresh: list[np.ndarray]) -> tuple[np.ndarray, dict, float]:
        """One window: ``tokens[t]`` are those of the first lanes at its t-th place, ``fresh[t]`` the lanes that start a document
        there.  The state after it, the gradients of the negative log-likelihood, and its mean."""
        kept: list = []
        states = []
        tail = h
        for ids, new in zip(tokens, fresh):
            own = tail if tail.shape[1] == len(ids) else tail[:, : len(ids)].copy()
            own[:, new] = 0.0
            states.append(own)
            tail = self.step(own, ids, kept)
        grads: dict = {}
        s, flat = np.concatenate(states, axis=1), np.concatenate(tokens)
        logp, ds = self.output(s, flat, grads)
        ends = np.cumsum([len(x) for x in tokens]).tolist()
        d = self.hidden
        back = np.zeros_like(tail)
        d_in, d_state = [], []
        for t in range(len(tokens) - 1, -1, -1):
            old, gates, n, m = kept[t]
            z, r = gates[:d], gates[d:]
            gate = np.empty((3 * d, back.shape[1]), dtype=back.dtype)
            dn = gate[2 * d :]
            np.subtract(1.0, z, out=dn)
            dn *= back
            dn *= 1.0 - n * n
            np.subtract(old, n, out=gate[:d])
            gate[:d] *= back
            np.multiply(dn, m, out=gate[d : 2 * d])
            slope = 1.0 - gates
            slope *= gates
            slope *= 2.0
            gate[: 2 * d] *= slope
            d_in.append(gate)
            hidden = gate.copy()
            hidden[2 * d :] *= r
            d_state.append(hidden)
            here = self.state.T @ hidden
            here += ds[:, ends[t] - len(tokens[t]) : ends[t]]
            back *= z
            here += back
            here[:, fresh[t]] = 0.0
            back = here
            if t and len(tokens[t - 1]) > back.shape[1]:
                back = np.zeros((d, len(tokens[t - 1])), dtype=here.dtype)
                back[:, : here.shape[1]] = here
        grads["state"] = np.concatenate(d_state[::-1], axis=1) @ s.T
        order = np.argsort(flat.astype(np.int16), kind="stable")
        ids = flat[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        grads["input"] = np.zeros_like(self.input)
        grads["input"][:, ids[first]] = np.add.reduceat(np.take(np.concatenate(d_in[::-1], axis=1), order, axis=1), first, axis=1)
        return tail, grads, -float(logp.mean())


def lanes_of(documents: list[np.ndarray], lanes: int, window: int) -> Iterator[tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]]:
    """Windows over documents laid end to end in lanes of nearly equal length: of each place, the lanes' tokens, which lanes
    start a document there, and the documents.  Lanes are ordered from long to short, so those that go on come first."""
    longest = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    heap = [(0, k) for k in range(min(lanes, len(documents)))]
    laid: list[list[int]] = [[] for _ in heap]
    for i in longest:
        size, k = heap[0]
        laid[k].append(i)
        heapq.heapreplace(heap, (size + len(documents[i]), k))
    laid = [laid[k] for _, k in sorted(heap, reverse=True)]
    order = np.array([i for lane in laid for i in lane])
    sizes = np.array([len(documents[i]) for i in order])
    whole = np.concatenate([documents[i] for i in order])
    owner = np.repeat(order, sizes).astype(np.int32)
    starts = np.zeros(len(whole), dtype=bool)
    starts[np.cumsum(sizes) - sizes] = True
    lengths = np.array([sum(len(documents[i]) for i in lane) for lane in laid])
    offsets = np.cumsum(lengths) - lengths
    for begin in range(0, int(lengths[0]), window):
        tokens, fresh, owners = [], [], []
        for t in range(begin, min(begin + window, int(lengths[0]))):
            at = offsets[: int(np.searchsorted(-lengths, -t, side="left"))] + t  # lanes longer than t
            tokens.append(whole[at])
            fresh.append(np.flatnonzero(starts[at]))
            owners.append(owner[at])
        yield tokens, fresh, owners


def train(model: Gru, documents: Iterator[list[np.ndarray]], rate: float = RATE, window: int = WINDOW) -> int:
    """Truncated backpropagation with Adam over groups of documents; the number of tokens seen."""
    m = {n: np.zeros_like(getattr(model, n)) for n in Gru.NAMES}
    v = {n: np.zeros_like(getattr(model, n)) for n in Gru.NAMES}
    step = tokens = 0
    for group in documents:
        h = np.zeros((model.hidden, min(LANES, len(group))), dtype=np.float32)
        for places, fresh, _ in lanes_of(group, LANES, window):
            h, grads, _ = model.gradients(h, places, fresh)
            n = sum(map(len, places))
            tokens += n
            step += 1
            size = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            # Small windows at the end of long documents move the parameters in proportion to their tokens.
            scale = min(1.0, 5.0 / (size / n + 1e-12)) / n
            pace = rate * min(1.0, n / 1024) / (1.0 + step / 400)
            for name, g in grads.items():
                g *= scale
                m[name] += 0.1 * (g - m[name])
                v[name] += 0.01 * (g * g - v[name])
                move = m[name] / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-7)
                setattr(model, name, getattr(model, name) - np.float32(pace / (1 - 0.9**step)) * move)
    return tokens


def log_likelihoods(model: Gru, documents: list[np.ndarray], window: int = WINDOW) -> np.ndarray:
    """Natural log-probability of each document's tokens (rare words by class only), the state carried from end to end."""
    out = np.zeros(len(documents))
    h = np.zeros((model.hidden, min(LANES, len(documents))), dtype=np.float32)
    for places, fresh, owners in lanes_of(documents, LANES, window):
        states = []
        for ids, new in zip(places, fresh):
            if h.shape[1] > len(ids):
                h = h[:, : len(ids)].copy()
            h[:, new] = 0.0
            states.append(h)
            h = model.step(h, ids)
        logp, _ = model.output(np.concatenate(states, axis=1), np.concatenate(places))
        out += np.bincount(np.concatenate(owners), weights=logp, minlength=len(out))
    return out


# --- over the corpus -----------------------------------------------------------------------------------------------


class _Coder:
    """Texts to lexicon codes and model tokens."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.known = lexicon, lexicon.classes * CLASS_SIZE
        self.words, self.ids = pa.array(lexicon.words, pa.binary()), lexicon.model_ids()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Codes (-1 outside the lexicon) and model tokens of all texts one after the other, each with its end; where each text begins, and where the last one ends; the words outside of each."""
        words, sizes = words_of(texts)
        starts = np.append(0, np.cumsum(sizes + 1))
        word = np.ones(starts[-1], dtype=bool)
        word[starts[1:] - 1] = False
        found = pc.index_in(words.cast(pa.binary()), value_set=self.words)
        own = pc.fill_null(found, -1).to_numpy()
        codes = np.full(len(word), self.lexicon.end, dtype=np.int32)
        codes[word] = own
        ids = self.ids[codes]
        out = np.flatnonzero(own < 0)
        missing = words.filter(pc.is_null(found)).dictionary_encode()
        kinds = len(missing.dictionary)
        places = missing.indices.to_numpy()
        text = np.repeat(np.arange(len(sizes)), sizes)[out]
        ids[out + text] = self.known + rare_classes(missing.dictionary)[places]  # a text's words come after the ends of those before it
        pairs, n = np.unique(text * max(1, kinds) + places, return_counts=True)
        text, at = np.divmod(pairs, max(1, kinds))
        rare = pa.StructArray.from_arrays([missing.dictionary.take(pa.array(at)).cast(pa.binary()), pa.array(n, pa.int32())], ["word", "n"])
        offsets = np.searchsorted(text, np.arange(len(sizes) + 1))
        return codes, ids, starts, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rare)


_READY: dict[int, _Coder] = {}
KEPT.append(_READY)


def _coder(shared) -> _Coder:
    """A task's coder, built once in each Python process for a broadcast lexicon."""
    if shared.id not in _READY:
        _READY.clear()
        _READY[shared.id] = _Coder(shared.value)
    return _READY[shared.id]


class _Shared:
    """A broadcast variable with a name that Python processes can remember it by."""

    def __init__(self, spark, value):
        self.handle = spark.sparkContext.broadcast(value)
        self.id = self.handle._jbroadcast.id()

    def __getstate__(self):
        return {"handle": self.handle, "id": self.id}

    @property
    def value(self):
        return self.handle.value


_CODED = "_rl_row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_part double, outside double, rare array<struct<word:binary,n:int>>, ids binary"


def _code_part(batches: Iterator[pa.RecordBatch], shared: _Shared) -> Iterator[pa.RecordBatch]:
    """Of each document: its tokens in the model, what its words add to the scores by counts alone, and its rare words."""
    coder = _coder(shared)
    lexicon = coder.lexicon
    seen = np.append(lexicon.counts, 0)  # the last is what code -1 finds
    log_c = np.log10(seen + 1.0)
    floor = math.log10(lexicon.tokens + lexicon.types + 1)
    class_floor = np.log10(lexicon.rare_tokens + lexicon.rare_types + 1)
    row = TaskContext.get().partitionId() << 33
    names = ["_rl_row", "doc_id", "held_out", "n_tokens", "n_known", "base_part", "outside", "rare", "ids"]
    # What a token adds to the model's score beyond the class that the model predicts: nothing, if it is known.
    beyond = np.concatenate([np.zeros(coder.known), class_floor])
    for batch in batches:
        if not len(batch):
            continue
        codes, ids, starts, words = coder(batch.column(2))
        known, at, sizes = log_c[codes], starts[:-1], np.diff(starts)
        base = np.add.reduceat(known, at) - sizes * floor
        outside = np.add.reduceat(np.where(ids >= coder.known, known - beyond[ids], 0.0), at)
        counted = np.add.reduceat((seen[codes] > 0).astype(np.int64), at)
        blobs = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((starts * 2).astype(np.int32)), pa.py_buffer(ids.astype("<i2"))])
        rows = np.arange(row, row + len(sizes))
        row += len(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0), batch.column(1), pa.array(sizes), pa.array(counted), pa.array(base), pa.array(outside), words, blobs], names)


def _train_part(batches: Iterator[pa.RecordBatch], shared: _Shared, start: np.ndarray, rate: float) -> Iterator[pa.RecordBatch]:
    """Rows (task, ids) come ordered by task: a model for each."""

    def rows() -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            for task, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield task, np.frombuffer(blob.as_py(), dtype="<i2")

    def groups(own: Iterator[tuple[int, np.ndarray]]) -> Iterator[list[np.ndarray]]:
        held, size = [], 0
        for _, ids in own:
            held.append(ids)
            size += len(ids)
            if size >= GROUP_TOKENS:
                yield held
                held, size = [], 0
        if held:
            yield held

    for task, own in itertools.groupby(rows(), key=lambda r: r[0]):
        model = Gru(_coder(shared).lexicon).load(start)
        tokens = train(model, groups(own), rate)
        release_memory(_READY)
        yield _sum_row(task, tokens, model.flat().astype(np.float64) * tokens)


def _sum_row(task: int, tokens: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([tokens], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["task", "tokens", "total"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by task, those of ``FAN_IN`` tasks that follow each other are one."""
    held: tuple[int, int, np.ndarray] | None = None
    for batch in batches:
        for task, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            flat, into = np.frombuffer(blob.as_py(), dtype=np.float64), task // FAN_IN
            if held is not None and held[0] == into:
                held = (into, held[1] + n, held[2] + flat)
                continue
            if held is not None:
                yield _sum_row(*held)
            held = (into, n, flat.copy())
    if held is not None:
        yield _sum_row(*held)


_SUMS = "task int, tokens long, total binary"


def fit(coded: DataFrame, shared: _Shared, rate: float = RATE) -> Gru:
    """Train on all rows of ``coded`` that aren't held out: tasks dealt by hash, averaged by tokens up a tree, in two rounds."""
    model = Gru(shared.value)
    tasks = max(1, -(-shared.value.tokens // TASK_TOKENS))
    learn = coded.where("not held_out").select("ids", F.xxhash64("doc_id", "ids", F.lit(SEED)).alias("_rl_place"))
    share = F.pmod(F.col("_rl_place"), F.lit(FIRST_SHARE))
    for chosen, pace, tasks in ((share == 0, rate, -(-tasks // FIRST_SHARE)), (share != 0, rate / 2, tasks)):  # the first round has a share of the tokens, so of the tasks too
        task = F.pmod(F.shiftright("_rl_place", 8), F.lit(tasks)).cast("int")
        dealt = learn.where(chosen).withColumn("task", task).repartition(4 * tasks, "task").sortWithinPartitions("task", "_rl_place")
        parts = materialize(dealt.select("task", "ids").mapInArrow(partial(_train_part, shared=shared, start=model.flat(), rate=pace), _SUMS), "trained")
        width = tasks
        while width > 1:
            width = -(-width // FAN_IN)
            up = parts.withColumn("_rl_into", F.floor(F.col("task") / FAN_IN)).repartition(width, "_rl_into").sortWithinPartitions("task").drop("_rl_into")
            above = materialize(up.mapInArrow(_add_up, _SUMS), "trained")
            discard(parts)
            parts = above
        for _, tokens, total in parts.collect():
            model.load(np.frombuffer(total, dtype=np.float64) / tokens)
        discard(parts)
    return model


_SCORED = "_rl_row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_part double, score_part double"


def _score_part(batches: Iterator[pa.RecordBatch], shared: _Shared, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    model = Gru(_coder(shared).lexicon).load(flat)

    def rows(held):
        whole = pa.Table.from_batches(held)
        gru = log_likelihoods(model, [np.frombuffer(x.as_py(), dtype="<i2") for x in whole.column("ids")]) / math.log(10)
        names = ["_rl_row", "doc_id", "held_out", "n_tokens", "n_known", "base_part"]
        out = whole.select(names).append_column("score_part", pa.array(gru + whole.column("outside").to_numpy()))
        yield from out.combine_chunks().to_batches(max_chunksize=8192)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes // 2
        if size >= SCORE_TOKENS:
            yield from rows(held)
            held, size = [], 0
    if size:
        yield from rows(held)
    held.clear()
    release_memory(_READY)


def is_held_out(doc_id):
    """Rows whose crc32(doc_id as text) mod 7 is 2; a row without doc_id is not."""
    return F.coalesce(remainder_of_crc32(doc_id, 7) == 2, F.lit(False))


def score(docs: DataFrame, held_out=is_held_out, lexicon_words: int = LEXICON, rate: float = RATE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) for every row of ``docs``.

    Learns from the rows that aren't held out.  A null text is the empty one: one token, its end.  Repeated rows count and are
    scored each; other columns are not read.  With nothing to learn from, counts are zero and the model is that of its
    first parameters; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counts = materialize(count_words(source.where(~held_out(F.col("doc_id")))), "words")
    shared = _Shared(spark, build_lexicon(counts, lexicon_words))
    lexicon = shared.value
    coded = materialize(source.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(partial(_code_part, shared=shared), _CODED), "coded")
    model = fit(coded, shared, rate)
    scored = coded.select("_rl_row", "doc_id", "held_out", "n_tokens", "n_known", "base_part", "outside", "ids").mapInArrow(partial(_score_part, shared=shared, flat=model.flat()), _SCORED)
    # What a word outside the lexicon adds needs its count: c + 1 stands in both scores' numerators.
    rare = coded.select("_rl_row", F.inline("rare")).join(counts, "word")
    added = rare.groupBy("_rl_row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("added"), F.sum("n").alias("found"))
    out = scored.join(added, "_rl_row", "left")
    more = F.coalesce("added", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).cast("long").alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("base_part") + more).alias("base_score"),
        (F.col("score_part") + more).alias("score"),
    )
