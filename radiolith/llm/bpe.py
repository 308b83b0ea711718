"""Byte-level BPE encoding and decoding.

A text is split at special tokens and by the byte-level pre-tokenization pattern; every piece is encoded by
a contiguous rank array: the parts between the remaining boundaries and the rank of every adjacent pair lie in two
short arrays, the least rank is found by a scan, its inner boundary is deleted and the two neighbouring ranks are
refreshed, until no pair has a rank.  The new pieces of a batch of texts go through this together, a row each of two
numpy matrices.  Pieces longer than ``ARRAY_LIMIT`` bytes take the same merges from a heap over a linked list, so
a run of 100,000 letters costs n log n and not n squared.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT

ARRAY_LIMIT = 32
#: Pieces that are remembered, at about 220 bytes each.
CACHE_LIMIT = 200_000
#: Characters of texts that are held in pieces at a time.
AT_ONCE = 1 << 20
#: White space of the pre-tokenization pattern, and its contractions.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _ranges(wanted) -> str:
    """A character class body holding every code point for which ``wanted`` holds."""
    out, start = [], None
    for code in range(0x110001):
        inside = code < 0x110000 and not 0xD800 <= code < 0xE000 and wanted(chr(code))
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(out)


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = {chr(b): b for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in set(printable)):
        symbols[chr(256 + n)] = b
    return symbols


class _Pieces(dict):
    """Remembers the ids of pieces, packed in four bytes each; when there are too many, only those of the texts at hand stay."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        return self.encode([piece.encode("utf-8")])[0]

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode together what isn't remembered, if it isn't too long to be."""
        new = [p for p in pieces if len(p) <= 64]
        for at in range(0, len(new), 1 << 14):
            some = new[at : at + (1 << 14)]
            self.update(zip(some, self.encode([p.encode("utf-8") for p in some])))

    def forget_all_but(self, pieces: set[str]) -> None:
        kept = {p: self[p] for p in pieces if p in self}
        self.clear()
        self.update(kept)


class ByteBPE:
    """Encoder and decoder of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = _byte_symbols()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode("utf-8")
        self.byte_ids = [0] * 256
        for c, b in symbols.items():
            self.byte_ids[b] = vocab[c]
        self.shift = size.bit_length()
        self.pair_rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pair_rank[vocab[left] << self.shift | vocab[right]] = rank
            self.merged.append(vocab[left + right])
        pairs = np.fromiter(self.pair_rank, dtype=np.int64, count=len(self.pair_rank))
        order = np.argsort(pairs)
        #: The pairs that merge in order, each one's rank (and that of no pair, behind), and what ranks merge into.
        self.pairs = np.append(pairs[order], np.int64(1) << 62)
        self.pair_ranks = np.append(np.fromiter(self.pair_rank.values(), dtype=np.int32, count=len(pairs))[order], np.int32(len(pairs)))
        self.merged_ids = np.array([*self.merged, 0], dtype=np.int32)
        self.first_ids = np.array(self.byte_ids, dtype=np.int32)
        two = np.arange(1 << 16)
        self.byte_ranks = self._ranks(self.first_ids[two >> 8], self.first_ids[two & 255])
        self.id_text = [str(i) for i in range(size)]
        old = unicodedata.ucd_3_2_0.category
        letters = _ranges(lambda c: old(c)[0] == "L")
        numbers = _ranges(lambda c: old(c)[0] == "N")
        self.split = re.compile(f"{CONTRACTIONS}| ?[{letters}]+| ?[{numbers}]+| ?[^{WHITE}{letters}{numbers}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall
        #: The same for texts of Latin-1 characters only, whose classes are small.
        latin = [_ranges(lambda c, k=k: c < "\u0100" and old(c)[0] == k) for k in "LN"]
        narrow = WHITE[: WHITE.index("\\u1680")]
        self.split_latin = re.compile(f"{CONTRACTIONS}| ?[{latin[0]}]+| ?[{latin[1]}]+| ?[^{narrow}{''.join(latin)}]+|[{narrow}]+(?![^{narrow}])|[{narrow}]+").findall
        #: Characters whose class differs between Unicode versions: texts with them are split by the library.
        self.unsettled = re.compile(f"[{_ranges(lambda c: old(c) == 'Cn' or old(c)[0] != unicodedata.category(c)[0])}]").search
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = _Pieces(self.encode_pieces)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; the number of merges where a pair has none."""
        key = (left.astype(np.int64) << self.shift) | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], np.int32(len(self.merged)))

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokenized pieces, packed as four little-endian bytes each."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        out: list[bytes] = [b""] * len(pieces)
        for least, most in ((1, 8), (9, 16), (17, ARRAY_LIMIT)):
            own = np.flatnonzero((sizes >= least) & (sizes <= most))
            if len(own):
                self._encode_short([pieces[i] for i in own.tolist()], sizes[own], most, own, out)
        for i in np.flatnonzero(sizes > ARRAY_LIMIT).tolist():
            out[i] = np.array(self._encode_long(pieces[i]), dtype="<u4").tobytes()
        return out

    def _encode_short(self, pieces: list[bytes], sizes: np.ndarray, width: int, place: np.ndarray, out: list[bytes]) -> None:
        none = np.int32(len(self.merged))
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(len(pieces), width)
        column = np.arange(width)
        ids = self.first_ids[raw]
        ranks = np.full((len(pieces), width), none, dtype=np.int32)
        ranks[:, :-1] = self.byte_ranks[(raw[:, :-1].astype(np.int32) << 8) | raw[:, 1:]]
        ranks[column >= sizes[:, None] - 1] = none
        left = sizes.copy()
        while len(ids):
            row = np.arange(len(ids))
            at = ranks.argmin(axis=1)
            least = ranks[row, at]
            done = least == none
            if done.any():
                packed, lengths = ids[done].astype("<u4"), left[done].tolist()
                for i, values, n in zip(place[done].tolist(), packed, lengths):
                    out[i] = values[:n].tobytes()
                on = ~done
                ids, ranks, left, place, at, least = ids[on], ranks[on], left[on], place[on], at[on], least[on]
                row = np.arange(len(ids))
                if not len(ids):
                    break
            # The boundary after part ``at`` goes: parts and ranks behind it move up by one.
            moved = column[:-1] > at[:, None]
            ids[:, :-1] = np.where(moved, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(moved | (column[:-1] == at[:, None]), ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = none
            left -= 1
            ids[row, at] = self.merged_ids[least]
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at + 1 < left)
            b, a = at[before], at[after]
            ranks[before, b - 1] = self._ranks(ids[before, b - 1], ids[before, b])
            ranks[after, a] = self._ranks(ids[after, a], ids[after, a + 1])

    def _encode_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges in the same order for a piece of any length."""
        rank_of, merged, shift = self.pair_rank.get, self.merged, self.shift
        ids: list[int] = [self.byte_ids[b] for b in piece]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank_of(a << shift | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = merged[rank], False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (r := rank_of(ids[left] << shift | ids[right])) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return tuple(x for x, on in zip(ids, alive) if on)

    def split_pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")  # all settled
            return self.split_latin(text)
        except UnicodeEncodeError:
            if self.unsettled(text):
                from tokenizers.pre_tokenizers import ByteLevel

                return [text[i:j] for _, (i, j) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]
        return self.split(text)

    def _parts(self, text: str) -> list[list[str] | int]:
        """A text as runs of pieces and ids of special tokens."""
        if not any(token in text for token in self.special):
            return [self.split_pieces(text)]
        return [self.special[part] if part in self.special else self.split_pieces(part) for part in self.specials.split(text) if part]

    def encode_packed(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of whole texts, packed as four little-endian bytes each; None is the empty text.

        New pieces of some ``AT_ONCE`` characters of texts are learned together; no more texts than that are held in pieces."""
        get, held, missing, size = self.pieces.get, [], set(), 0
        for text in texts:
            parts = self._parts(text) if text else []
            found = []
            for p in parts:
                if isinstance(p, list):
                    ids = list(map(get, p))
                    gaps = None in ids
                    if gaps:
                        missing.update(w for w, x in zip(p, ids) if x is None)
                    found.append((p, ids, gaps))
                else:
                    found.append(([], [p.to_bytes(4, "little")], False))
            held.append(found)
            size += len(text or "")
            if size >= AT_ONCE:
                yield from self._joined(held, missing)
                held, missing, size = [], set(), 0
        yield from self._joined(held, missing)

    def _joined(self, held: list, missing: set[str]) -> Iterator[bytes]:
        self.pieces.learn(missing)
        look = self.pieces.__getitem__
        for found in held:
            yield b"".join([b"".join([look(w) if x is None else x for w, x in zip(p, ids)] if gaps else ids) for p, ids, gaps in found])
        if len(self.pieces) > CACHE_LIMIT:
            self.pieces.forget_all_but({w for found in held for p, _, _ in found for w in p})

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; None is the empty text, special tokens in it become their ids."""
        return np.frombuffer(next(self.encode_packed([text])), dtype="<u4").tolist()

    def decode(self, ids) -> str:
        """Text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", errors="replace")


_LOADED: dict[str, ByteBPE] = {}
KEPT.append(_LOADED)


def load_bpe(path: str) -> ByteBPE:
    """The encoder of a vocabulary file, built once in each Python process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def encode_texts(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column of token ids after its own; None is the empty text. No shuffle."""

    @F.pandas_udf("array<int>")
    def run(texts):
        bpe = load_bpe(vocabulary)
        return pd.Series([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in bpe.encode_packed(texts)], dtype=object)

    return df.withColumn(ids, run(F.coalesce(df[text], F.lit(""))))


def decode_ids(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of a column of token ids; None is no ids."""

    @F.pandas_udf("string")
    def run(rows):
        bpe = load_bpe(vocabulary)
        return rows.map(lambda x: bpe.decode([] if x is None else x), na_action=None)

    return df.withColumn(text, run(df[ids]))


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode and decode every document and keep digests of both, one row per input row.

    Takes ``doc_id`` and ``text`` and no other column.  A null text is the empty text (0 tokens); repeated rows
    give repeated results; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(vocabulary)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for packed in bpe.encode_packed(batch.column(1).to_pylist()):
                ids = np.frombuffer(packed, dtype="<u4").tolist()
                counts.append(len(ids))
                encoded.append(hashlib.sha256(",".join(map(bpe.id_text.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
