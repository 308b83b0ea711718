"""Pixels of encapsulated files: fragments and frames, run-length segments, lossless JPEG; each syntax has a first and a second decoder.

The first decoder of a syntax does a frame's work in numpy and refuses what it isn't made for; the second goes symbol by symbol and
takes the whole syntax.  Which of them gave the pixels, and which were tried, goes with the result; what none decodes says why of each.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

# The standard's identifiers of encapsulated transfer syntaxes.
RLE = "1.2.840.10008.1.2.5"
JPEG_LOSSLESS = "1.2.840.10008.1.2.4.57"
JPEG_LOSSLESS_FIRST_ORDER = "1.2.840.10008.1.2.4.70"
_ITEM, _SEQUENCE_END = (0xFFFE, 0xE000), (0xFFFE, 0xE0DD)


class Undecodable(ValueError):
    """Pixels that a decoder can't read."""


def fragments_of(data: bytes, at: int) -> tuple[list[int], list[bytes]]:
    """Offsets of frames and fragments of an encapsulated value that begins at ``at``."""
    items = []
    while True:
        if at + 8 > len(data):
            raise Undecodable("file ends before its last fragment")
        tag, size = struct.unpack_from("<HH", data, at), struct.unpack_from("<I", data, at + 4)[0]
        at += 8
        if tag == _SEQUENCE_END:
            break
        if tag != _ITEM or at + size > len(data):
            raise Undecodable("a fragment is cut or out of place")
        items.append(bytes(data[at : at + size]))
        at += size
    if not items:
        raise Undecodable("no offset table")
    return [x[0] for x in struct.iter_unpack("<I", items[0][: len(items[0]) // 4 * 4])], items[1:]


def frames_of(offsets: list[int], fragments: list[bytes], frames: int) -> list[bytes]:
    """Fragments joined by frame: by the offset table, one each, or all of a single frame's."""
    if frames == 1:
        return [b"".join(fragments)]
    if len(offsets) == frames:
        begins = np.cumsum([0] + [len(f) + 8 for f in fragments])[: len(fragments)]
        frame = np.searchsorted(np.array(offsets), begins, side="right") - 1
        if set(offsets) - set(begins.tolist()) or len(fragments) == 0:
            raise Undecodable("offsets don't point at fragments")
        return [b"".join(f for f, k in zip(fragments, frame.tolist()) if k == n) for n in range(frames)]
    if len(fragments) == frames:
        return fragments
    raise Undecodable(f"{len(fragments)} fragments for {frames} frames and no offset table")


# --- run lengths ---------------------------------------------------------------------------------------------------


def _segments(data: bytes, expected: int) -> list[bytes]:
    if len(data) < 64:
        raise Undecodable("no segment header")
    count, *offsets = struct.unpack_from("<16I", data)
    if count != expected:
        raise Undecodable(f"{count} segments where samples and bytes make {expected}")
    bounds = [*offsets[:count], len(data)]
    if any(not 64 <= a <= b for a, b in zip(bounds, bounds[1:])):
        raise Undecodable("segments out of order")
    return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def _assembled(planes: list[np.ndarray], shape: tuple[int, int, int], size: int) -> np.ndarray:
    rows, columns, samples = shape
    whole = np.stack(planes).reshape(samples, size, rows, columns).astype(np.uint32)
    value = np.zeros((samples, rows, columns), dtype=np.uint32)
    for k in range(size):  # the byte of highest weight comes first
        value = (value << np.uint32(8)) | whole[:, k]
    return np.moveaxis(value, 0, -1)


def rle_by_runs(data: bytes, shape: tuple[int, int, int], bits: int) -> np.ndarray:
    """Runs as (place, length, value) first, then laid out together."""
    rows, columns, samples = shape
    planes, size = [], bits // 8
    for segment in _segments(data, samples * size):
        raw = np.frombuffer(segment, dtype=np.uint8)
        starts, lengths, literal, at, total, n = [], [], [], 0, 0, rows * columns
        while total < n and at < len(segment):
            head = segment[at]
            if head == 128:
                at += 1
                continue
            own = head < 128
            length = head + 1 if own else 257 - head
            starts.append(at + 1)
            lengths.append(length)
            literal.append(own)
            at += 1 + (length if own else 1)
            total += length
        if total < n or at > len(segment):
            raise Undecodable("a segment ends early")
        length = np.array(lengths)
        begin = np.repeat(np.array(starts), length)
        within = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        planes.append(raw[begin + np.where(np.repeat(literal, length), within, 0)][:n])
    return _assembled(planes, shape, size)


def rle_by_bytes(data: bytes, shape: tuple[int, int, int], bits: int) -> np.ndarray:
    """Run after run into a buffer."""
    rows, columns, samples = shape
    planes = []
    for segment in _segments(data, samples * bits // 8):
        out, at = bytearray(), 0
        while len(out) < rows * columns:
            if at >= len(segment):
                raise Undecodable("a segment ends early")
            head, at = segment[at], at + 1
            if head < 128:
                out += segment[at : at + head + 1]
                at += head + 1
            elif head > 128:
                out += segment[at : at + 1] * (257 - head)
                at += 1
            if at > len(segment):
                raise Undecodable("a segment ends early")
        planes.append(np.frombuffer(bytes(out[: rows * columns]), dtype=np.uint8))
    return _assembled(planes, shape, bits // 8)


# --- lossless JPEG -------------------------------------------------------------------------------------------------


class _Jpeg:
    """Markers of a lossless JPEG frame: precision, size, Huffman tables by component, predictor, restart interval, coded bytes."""

    def __init__(self, data: bytes):
        self.restart, tables, at = 0, {}, 2
        if data[:2] != b"\xff\xd8":
            raise Undecodable("no JPEG")
        self.components: list[int] = []
        while True:
            if at + 4 > len(data) or data[at] != 0xFF:
                raise Undecodable("JPEG markers end early")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            if marker == 0xC4:
                k = 0
                while k + 17 <= len(body):
                    counts = list(body[k + 1 : k + 17])
                    tables[body[k] & 15] = (counts, list(body[k + 17 : k + 17 + sum(counts)]))
                    k += 17 + sum(counts)
            elif marker == 0xC3:
                self.precision, self.rows, self.columns, n = struct.unpack_from(">BHHB", body)
                if any(body[7 + 3 * k] != 0x11 for k in range(n)):
                    raise Undecodable("components of different sizes")
                self.components = [body[6 + 3 * k] for k in range(n)]
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise Undecodable(f"JPEG process of marker {marker:02x} isn't lossless by Huffman codes")
            elif marker == 0xDD:
                self.restart = struct.unpack_from(">H", body)[0]
            elif marker == 0xDA:
                n = body[0]
                if n != len(self.components):
                    raise Undecodable("a scan for each component")
                try:
                    self.tables = [tables[body[2 + 2 * k] >> 4] for k in range(n)]
                except KeyError:
                    raise Undecodable("a Huffman table is missing") from None
                self.predictor, self.shift = body[1 + 2 * n], body[3 + 2 * n] & 15
                self.coded = data[at + 2 + size :]
                return
            at += 2 + size

    def intervals(self) -> list[bytes]:
        """Coded bytes between restart markers, stuffing undone."""
        out, begin, at, data = [], 0, 0, self.coded
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                out.append(data[begin:])
                break
            if 0xD0 <= data[at + 1] <= 0xD7:
                out.append(data[begin:at])
                begin = at = at + 2
            elif data[at + 1] == 0:
                at += 2
            elif data[at + 1] == 0xFF:
                at += 1
            else:
                out.append(data[begin:at])
                break
        return [x.replace(b"\xff\x00", b"\xff") for x in out]


def _codes(table: tuple[list[int], list[int]]) -> list[tuple[int, int, int]]:
    """(code, length, category) of a table of counts by length."""
    counts, values = table
    out, code, at = [], 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            if at >= len(values) or code >> length:
                raise Undecodable("a Huffman table overflows")
            out.append((code, length, values[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def jpeg_by_jumps(data: bytes, shape: tuple[int, int, int], bits: int) -> np.ndarray:
    """For every bit where the next symbol would begin, then along those jumps; one component, no restarts, and prediction from the left, from above or planar."""
    jpeg = _Jpeg(data)
    rows, columns, samples = shape
    if (jpeg.rows, jpeg.columns, len(jpeg.components)) != shape or samples != 1:
        raise Undecodable("size or components don't fit")
    if jpeg.restart or jpeg.predictor not in (1, 2, 4) or jpeg.shift:
        raise Undecodable(f"predictor {jpeg.predictor}, restart interval {jpeg.restart}, shift {jpeg.shift}")
    length, category = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=np.int32)
    for code, size, value in _codes(jpeg.tables[0]):
        length[code << (16 - size) : (code + 1) << (16 - size)] = size
        category[code << (16 - size) : (code + 1) << (16 - size)] = value
    raw = np.frombuffer(jpeg.intervals()[0] + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    words = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
    end = 8 * (len(raw) - 8)
    bit = np.arange(8, dtype=np.uint32)
    window = ((words[: len(raw) - 4, None] >> (np.uint32(16) - bit)) & np.uint32(0xFFFF)).ravel().astype(np.int32)
    more = np.where(category == 16, 0, category)
    step = np.where(length[window[:end]] > 0, length[window[:end]] + more[window[:end]], 1 << 28)
    after = (np.arange(end, dtype=np.int64) + step).tolist()
    n, at, place = rows * columns, 0, []
    for _ in range(n):
        if at >= end:
            raise Undecodable("coded pixels end early")
        place.append(at)
        at = after[at]
    if at > end:
        raise Undecodable("coded pixels end early")
    symbol = window[place]
    size = category[symbol]
    extra = window[np.array(place) + length[symbol]] >> (16 - np.minimum(size, 16))
    difference = np.where(size == 16, 32768, np.where(size == 0, 0, np.where(extra < 1 << np.maximum(size - 1, 0), extra - (1 << size) + 1, extra))).reshape(rows, columns)
    # The first row is predicted from the left, the first column from above, all from a middle value.
    difference[0, 0] += 1 << (jpeg.precision - 1)
    if jpeg.predictor == 1:
        difference[:, 0] = np.cumsum(difference[:, 0])
        value = np.cumsum(difference, axis=1)
    elif jpeg.predictor == 2:
        difference[0] = np.cumsum(difference[0])
        value = np.cumsum(difference, axis=0)
    else:  # left + above - corner: differences of both directions
        value = difference.astype(np.int64)
        first_row, first_column = np.cumsum(value[0]), np.cumsum(value[:, 0])
        inner = np.cumsum(np.cumsum(value[1:, 1:], axis=0), axis=1)
        value[0], value[:, 0] = first_row, first_column
        value[1:, 1:] = inner + first_row[None, 1:] + first_column[1:, None] - first_row[0]
    return (value & 0xFFFF).astype(np.uint32).reshape(shape)


def jpeg_by_symbols(data: bytes, shape: tuple[int, int, int], bits: int) -> np.ndarray:
    """Symbol after symbol: any predictor, components and restart intervals."""
    jpeg = _Jpeg(data)
    rows, columns, samples = shape
    if (jpeg.rows, jpeg.columns, len(jpeg.components)) != shape:
        raise Undecodable("size or components don't fit")
    if not 1 <= jpeg.predictor <= 7:
        raise Undecodable(f"predictor {jpeg.predictor}")
    lookups = [{(length, code): value for code, length, value in _codes(t)} for t in jpeg.tables]
    out = np.zeros(shape, dtype=np.int64)
    intervals, each = jpeg.intervals(), jpeg.restart or rows * columns
    begin = 0
    for part in intervals:
        whole, left, taken = int.from_bytes(part, "big"), 8 * len(part), 0
        text = bin(whole)[2:].zfill(left) if left else ""
        for k in range(begin, min(begin + each, rows * columns)):
            y, x = divmod(k, columns)
            for s in range(samples):
                code, length = 0, 0
                while (length, code) not in lookups[s]:
                    if taken >= left or length == 16:
                        raise Undecodable("coded pixels end early or hold no code")
                    code, length, taken = 2 * code + (text[taken] == "1"), length + 1, taken + 1
                size = lookups[s][length, code]
                if size == 16:
                    difference = 32768
                elif size:
                    if taken + size > left:
                        raise Undecodable("coded pixels end early")
                    difference = int(text[taken : taken + size], 2)
                    taken += size
                    if difference < 1 << (size - 1):
                        difference -= (1 << size) - 1
                else:
                    difference = 0
                first_line = y == begin // columns
                if k == begin:
                    guess = 1 << (jpeg.precision - jpeg.shift - 1)
                elif first_line:
                    guess = out[y, x - 1, s]
                elif x == 0:
                    guess = out[y - 1, x, s]
                else:
                    a, b, c = int(out[y, x - 1, s]), int(out[y - 1, x, s]), int(out[y - 1, x - 1, s])
                    guess = (a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[jpeg.predictor - 1]
                out[y, x, s] = (int(guess) + difference) & 0xFFFF
        begin += each
        if begin >= rows * columns:
            break
    if begin < rows * columns:
        raise Undecodable("restart intervals are missing")
    return (out << jpeg.shift).astype(np.uint32)


Decoder = Callable[[bytes, tuple[int, int, int], int], np.ndarray]
#: Decoders of each syntax, in the order in which they are tried.
DECODERS: dict[str, list[tuple[str, Decoder]]] = {
    RLE: [("rle_by_runs", rle_by_runs), ("rle_by_bytes", rle_by_bytes)],
    JPEG_LOSSLESS: [("jpeg_by_jumps", jpeg_by_jumps), ("jpeg_by_symbols", jpeg_by_symbols)],
    JPEG_LOSSLESS_FIRST_ORDER: [("jpeg_by_jumps", jpeg_by_jumps), ("jpeg_by_symbols", jpeg_by_symbols)],
}


def decode_frames(syntax: str, frames: list[bytes], shape: tuple[int, int, int], kind: np.dtype) -> tuple[np.ndarray, str, list[str]]:
    """Frames (frame, row, column, sample) by the first decoder that reads all of them, its name, and the names that were tried.

    If none does, an error names what each of them said.
    """
    said: list[str] = []
    tried: list[str] = []
    for name, decoder in DECODERS.get(syntax, []):
        tried.append(name)
        try:
            values = np.stack([decoder(f, shape, 8 * kind.itemsize) for f in frames])
            return values.astype(f"u{kind.itemsize}").view(kind.newbyteorder("=")), name, tried
        except Exception as error:  # the next decoder may read it
            said.append(f"{name}: {type(error).__name__}: {error}")
    raise Undecodable("; ".join(said) if said else f"no decoder for transfer syntax {syntax}")
