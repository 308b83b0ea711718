"""DICOM files as tables: headers and pixel statistics, errors as rows.

The parser reads files of either byte order, explicit or implicit, deflated too, and takes whatever has a length and slices, so a header scan fetches only
the blocks that it looks at (:mod:`.ranged`).  Encapsulated pixels are run-length or lossless JPEG (:mod:`.codecs`); other syntaxes give header rows and pixel
errors.  Files are opened by the tasks that hold their paths; where Arrow doesn't reach the file system, their bytes come from Spark's ``binaryFile`` reader.
"""

from __future__ import annotations

import hashlib
import math
import struct
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import blake2b_number, identity_hash, path_part, slice_geometry
from ..functions.scratch import materialize
from ..operators.files import _qualified, list_files
from . import codecs, ranged
from .tables import _D, _I, _L, _S, HEADER, PIXELS, _struct, conform

# The standard's tag numbers of the elements that are kept.
TAGS = {
    (0x0002, 0x0010): "TransferSyntaxUID", (0x0008, 0x0018): "SOPInstanceUID", (0x0008, 0x0070): "Manufacturer", (0x0008, 0x103E): "SeriesDescription", (0x0008, 0x1090): "ManufacturerModelName",
    (0x0010, 0x0020): "PatientID", (0x0010, 0x0040): "PatientSex", (0x0010, 0x1010): "PatientAge", (0x0018, 0x0020): "ScanningSequence", (0x0018, 0x0021): "SequenceVariant", (0x0018, 0x0022): "ScanOptions",
    (0x0018, 0x0023): "MRAcquisitionType", (0x0018, 0x0024): "SequenceName", (0x0018, 0x0050): "SliceThickness", (0x0018, 0x0080): "RepetitionTime", (0x0018, 0x0081): "EchoTime", (0x0018, 0x0087): "MagneticFieldStrength",
    (0x0018, 0x0088): "SpacingBetweenSlices", (0x0018, 0x0091): "EchoTrainLength", (0x0018, 0x1020): "SoftwareVersions", (0x0018, 0x1030): "ProtocolName", (0x0018, 0x1314): "FlipAngle", (0x0020, 0x000D): "StudyInstanceUID",
    (0x0020, 0x000E): "SeriesInstanceUID", (0x0020, 0x0013): "InstanceNumber", (0x0020, 0x0032): "ImagePositionPatient", (0x0020, 0x0037): "ImageOrientationPatient", (0x0020, 0x0060): "Laterality", (0x0020, 0x0062): "ImageLaterality",
    (0x0028, 0x0002): "SamplesPerPixel", (0x0028, 0x0004): "PhotometricInterpretation", (0x0028, 0x0008): "NumberOfFrames", (0x0028, 0x0010): "Rows", (0x0028, 0x0011): "Columns", (0x0028, 0x0030): "PixelSpacing", (0x0028, 0x0100): "BitsAllocated",
    (0x0028, 0x0101): "BitsStored", (0x0028, 0x0102): "HighBit", (0x0028, 0x0103): "PixelRepresentation", (0x0028, 0x1050): "WindowCenter", (0x0028, 0x1051): "WindowWidth", (0x0028, 0x1052): "RescaleIntercept", (0x0028, 0x1053): "RescaleSlope",
}
NUMBERS = {"InstanceNumber", "SliceThickness", "RepetitionTime", "EchoTime", "MagneticFieldStrength", "SpacingBetweenSlices", "EchoTrainLength", "FlipAngle", "RescaleIntercept", "RescaleSlope"}
WHOLE = {"Rows", "Columns", "BitsAllocated", "BitsStored", "HighBit", "PixelRepresentation", "SamplesPerPixel", "NumberOfFrames"}
VECTORS = {"ImagePositionPatient", "ImageOrientationPatient", "PixelSpacing"}
LISTS = {"ScanningSequence", "SequenceVariant", "ScanOptions", "WindowCenter", "WindowWidth", "SoftwareVersions"}
LONG_VR = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"UC", b"UN", b"UR", b"UT", b"SV", b"UV"}
IMPLICIT, EXPLICIT, BIG, DEFLATED = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"
PIXEL_DATA = (0x7FE0, 0x0010)
_END = {(0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)}
_BINARY = {b"US": "H", b"SS": "h", b"UL": "I", b"SL": "i", b"FL": "f", b"FD": "d"}


class Unreadable(ValueError):
    """Bytes that aren't the DICOM this parser knows."""


def _element(data, at: int, explicit: bool, order: str = "<") -> tuple[tuple[int, int], bytes, int, int]:
    """Tag, VR, length and the place of the value."""
    head = data[at : at + 12]
    if len(head) < 8:
        raise Unreadable("file ends inside an element")
    tag = struct.unpack_from(order + "HH", head)
    if not explicit or tag[0] == 0xFFFE:
        return tag, b"", struct.unpack_from(order + "I", head, 4)[0], at + 8
    vr = head[4:6]
    if vr in LONG_VR:
        if len(head) < 12:
            raise Unreadable("file ends inside an element")
        return tag, vr, struct.unpack_from(order + "I", head, 8)[0], at + 12
    return tag, vr, struct.unpack_from(order + "H", head, 6)[0], at + 8


def _skip_undefined(data, at: int, explicit: bool, order: str) -> int:
    """Where a sequence or item of undefined length ends."""
    while True:
        tag, _, size, at = _element(data, at, explicit, order)
        if tag in _END:
            return at
        at = _skip_undefined(data, at, explicit, order) if size == 0xFFFFFFFF else at + size


def parse(data, pixels: bool = False) -> dict:
    """Kept elements as (VR, bytes in little-endian order) by keyword; with ``pixels`` also the pixel bytes, or offsets and fragments.  Stops at the pixels otherwise.

    ``data`` is bytes, or anything with a length that gives bytes for slices: of elements that aren't kept only the heads are asked for.
    """
    at, explicit, order, out = 0, False, "<", {}
    if data[128:132] == b"DICM":
        at = 132
        while data[at : at + 2] == b"\x02\x00":
            tag, vr, size, at = _element(data, at, True)
            if tag in TAGS:
                out[TAGS[tag]] = (vr, data[at : at + size])
            at += size
        syntax = _text(out["TransferSyntaxUID"][1]) if "TransferSyntaxUID" in out else IMPLICIT
        explicit, order = syntax != IMPLICIT, ">" if syntax == BIG else "<"
        if syntax == DEFLATED:
            data, at = zlib.decompress(data[at : len(data)], -15), 0
    elif len(data) >= 8:
        explicit = data[4:6].isalpha() and data[4:6].isupper()
    if at + 8 > len(data):
        raise Unreadable("no DICOM data set")
    seen = False
    while at + 8 <= len(data):
        tag, vr, size, value = _element(data, at, explicit, order)
        if tag[0] > 0x7FE0 or tag < (2, 0):
            if not seen:
                raise Unreadable("no DICOM data set")
            break
        if tag == PIXEL_DATA:
            if pixels and size == 0xFFFFFFFF:
                out["Fragments"] = codecs.fragments_of(data, value)
            elif pixels:
                out["PixelData"] = (vr, data[value : value + size])
            break
        if size == 0xFFFFFFFF:
            at = _skip_undefined(data, value, explicit, order)
            continue
        if value + size > len(data):
            raise Unreadable("file ends inside a value")
        if tag in TAGS:
            raw, width = data[value : value + size], struct.calcsize(_BINARY.get(vr, "B"))
            out[TAGS[tag]] = (vr, raw if order == "<" or width == 1 else b"".join(raw[k : k + width][::-1] for k in range(0, len(raw), width)))
        seen, at = True, value + size
    return out


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", errors="replace").strip(" \0")


def _number(text) -> float | None:
    try:
        x = float(text)
    except (TypeError, ValueError):
        return None
    return x if math.isfinite(x) else None


def typed(name: str, vr: bytes, raw: bytes):
    """A raw value in the type its column has; NULL if it can't be."""
    if not raw:
        return None
    if vr in _BINARY or (name in WHOLE and not vr):
        form = "<" + _BINARY.get(vr, "H")
        value = struct.unpack_from(form, raw)[0] if len(raw) >= struct.calcsize(form) else None
        return int(value) if name in WHOLE and value is not None else value
    text = _text(raw)
    if name in WHOLE:
        x = _number(text)
        return None if x is None else int(x)
    if name in NUMBERS:
        return _number(text.split("\\")[0])
    if name in VECTORS:
        values = [_number(t) for t in text.split("\\")]
        return None if None in values else values
    if name in LISTS:
        return [t.strip() for t in text.split("\\")]
    return text or None


def header_record(data) -> dict:
    """Header columns of a file (bytes, or what gives them for slices), PatientID among them; status, error type and message if it can't be read."""
    try:
        return {"status": "ok"} | {name: typed(name, *value) for name, value in parse(data).items()}
    except Exception as error:  # whatever is wrong with a file is a row of the result
        return {"status": "error", "error_type": type(error).__name__, "error_message": str(error)[:1000]}


def decoded(data: bytes) -> tuple[np.ndarray, float, float, str, list[str]]:
    """Pixels as stored, slope, intercept, the decoder that gave them, and the decoders that were tried."""
    raw = parse(data, pixels=True)
    value = lambda name, default: (lambda x: default if x is None else x)(typed(name, *raw[name]) if name in raw else None)
    if "PixelData" not in raw and "Fragments" not in raw:
        raise Unreadable("no pixels")
    syntax = _text(raw["TransferSyntaxUID"][1]) if "TransferSyntaxUID" in raw else IMPLICIT
    bits = value("BitsAllocated", 16)
    if bits not in (8, 16, 32):
        raise Unreadable(f"{bits} bits a pixel")
    order = ">" if syntax == BIG else "<"
    kind = np.dtype(f"{order}{'i' if value('PixelRepresentation', 0) else 'u'}{bits // 8}")
    shape = (value("NumberOfFrames", 1), value("Rows", 0), value("Columns", 0), value("SamplesPerPixel", 1))
    count = math.prod(shape)
    rescale = (float(value("RescaleSlope", 1.0)), float(value("RescaleIntercept", 0.0)))
    if not count:
        raise Unreadable("no rows, columns, frames or samples")
    if "Fragments" in raw:
        pixels, decoder, tried = codecs.decode_frames(syntax, codecs.frames_of(*raw["Fragments"], shape[0]), shape[1:], kind)
    elif syntax not in (IMPLICIT, EXPLICIT, BIG, DEFLATED):
        raise Unreadable(f"plain pixels under transfer syntax {syntax}")
    elif len(raw["PixelData"][1]) < count * kind.itemsize:
        raise Unreadable("fewer pixels than rows and columns say")
    else:
        pixels, decoder = np.frombuffer(raw["PixelData"][1], dtype=kind, count=count).astype(kind.newbyteorder("=")), "plain"
        tried = [decoder]
    return (pixels.reshape([n for n in shape if n > 1] or [1]), *rescale, decoder, tried)


def pixel_array(data: bytes) -> tuple[np.ndarray, float, float]:
    """Decoded pixels as stored, slope and intercept."""
    return decoded(data)[:3]


def pixel_record(data: bytes, deep: bool, hashed: bool = True) -> dict:
    """Pixel columns of a file's bytes."""
    out: dict = {"deep_statistics": deep}
    try:
        began = time.perf_counter()
        raw, slope, intercept, decoder, tried = decoded(data)
        out |= {"decode_seconds": time.perf_counter() - began, "decoder": decoder, "decoders_tried": tried}
        flat = raw.astype(np.float64).ravel() * slope + intercept
        x = flat[np.isfinite(flat)]
        if not len(x):
            raise ValueError("no pixel is finite")
        out |= {"status": "ok", "pixel_count": len(x), "minimum": x.min(), "maximum": x.max(), "mean": x.mean(), "deviation": x.std(), "zero_fraction": (x == 0).mean(), "finite_fraction": len(x) / len(flat)}
        if hashed:
            out["pixel_sha256"] = hashlib.sha256(np.ascontiguousarray(raw).tobytes()).hexdigest()
        if deep:
            y = x[:: max(1, -(-len(x) // 65536))]
            points = np.percentile(y, [0.1, 1, 5, 25, 50, 75, 95, 99, 99.9])
            out |= dict(zip(("p0_1", "p1", "p5", "p25", "p50", "p75", "p95", "p99", "p99_9"), points))
            share = np.histogram(y, bins=128)[0] / len(y)
            share = share[share > 0]
            out |= {"mad": np.median(np.abs(y - points[4])), "entropy": float(-(share * np.log2(share)).sum())}
        return {k: float(v) if isinstance(v, np.floating) else v for k, v in out.items()}
    except Exception as error:  # as above
        return {"deep_statistics": deep, "status": "error", "error_type": type(error).__name__, "error_message": str(error)[:1000]}


def contents_of(spark: SparkSession, root: str, paths: DataFrame | None = None) -> DataFrame:
    """relative_path, length, content and error of the files below ``root`` (of ``paths``, if given, each once).

    Tasks open the files whose paths they hold.  Where Arrow doesn't reach the file system, Spark reads all files below ``root`` and those of ``paths`` are joined
    to them, with no content in the shuffle while the paths are few.
    """
    base = _qualified(spark, root)
    if ranged.reaches(base):
        names = (list_files(spark, root) if paths is None else paths).select("relative_path").where("relative_path is not null").distinct()
        return ranged.contents(names, base)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = found.select(F.expr(f"substr(path, {len(base) + 2})").alias("relative_path"), "length", "content", F.lit(None).cast("string").alias("error"))
    return found if paths is None else found.join(paths.select("relative_path").distinct(), "relative_path", "left_semi")


def header_schema():
    """Columns of a header scan: those of the headers as they are in the file, PatientID among them, and what was fetched."""
    names = [f.name for f in HEADER.fields if f.name in set(TAGS.values())]
    scan = _struct(relative_path=_S, shard=_I, file_size_bytes=_L, bytes_fetched=_L, header_seconds=_D, status=_S, error_type=_S, error_message=_S)
    return _struct(**{f.name: f.dataType for f in scan.fields}, **{n: HEADER[n].dataType for n in names}, PatientID=_S)


def _whole_headers(spark: SparkSession, root: str, paths: DataFrame | None) -> DataFrame:
    """Headers from whole files, where byte ranges can't be had."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = header_schema()
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, size, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                began = time.perf_counter()
                row = header_record(content.as_py() or b"")
                rows.append({"relative_path": path, "file_size_bytes": size, "bytes_fetched": size, "header_seconds": time.perf_counter() - began} | {k: v for k, v in row.items() if k in arrow.names})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return contents_of(spark, root, paths).mapInArrow(run, shape)


def with_geometry(rows: DataFrame, salt: str) -> DataFrame:
    """Scanned headers as header rows: plane, normal, position, hashed patient; PatientID doesn't leave the scan."""
    ok = F.col("status") == "ok"
    rows = rows.withColumn("_g", slice_geometry("ImageOrientationPatient", "ImagePositionPatient")).withColumns(
        {
            "derived_plane": F.when(ok, F.col("_g.plane")), "slice_normal": F.col("_g.normal"), "position_scalar": F.col("_g.position"),
            "patient_hash": identity_hash("PatientID", salt), "path_study_uid": path_part("relative_path", 0), "path_series_uid": path_part("relative_path", 1),
        }
    )
    return conform(rows.drop("_g", "PatientID"), HEADER)


def read_headers(spark: SparkSession, root: str, salt: str, paths: DataFrame | None = None, index: str | None = None, shards: list[int] | None = None) -> DataFrame:
    """A header row for each file below ``root``, with plane, normal, position and hashed patient; what can't be read is a row with status 'error'.

    ``index`` is a folder of Parquet files with the paths, sizes and shards of the files to read, of which only ``shards`` are opened; without it
    the paths of ``paths``, or all files below ``root``, are written as one.  Only the blocks of a file up to its pixels are fetched.
    """
    base = _qualified(spark, root)
    if index is None:
        files = list_files(spark, root) if paths is None else paths
        kept = [c for c in ("relative_path", "size_bytes", "shard") if c in files.columns]
        files = files.select(*kept).where("relative_path is not null").dropDuplicates(["relative_path"])
        if not ranged.reaches(base):
            return with_geometry(_whole_headers(spark, root, files), salt)
        index = materialize(files, "paths")._scratch_path
    at = _qualified(spark, index)
    if not (ranged.reaches(base) and ranged.reaches(at)):
        listed = spark.read.parquet(index)
        return with_geometry(_whole_headers(spark, root, listed if shards is None else listed.where(F.col("shard").isin(shards))), salt)
    rows = ranged.scan_headers(spark, base, at)
    return with_geometry(rows if shards is None else rows.where(F.col("shard").isin(shards)), salt)


def deep_sample(relative_path: Column | str, rate: float) -> Column:
    """Whether a file is in the deterministic sample that gets deep statistics."""
    @F.pandas_udf("boolean")
    def chosen(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: blake2b_number(p) / ((1 << 64) - 1) < rate)

    return chosen(F.col(relative_path) if isinstance(relative_path, str) else relative_path)


def read_pixels(spark: SparkSession, root: str, deep_rate: float = 0.0, hashed: bool = True, paths: DataFrame | None = None) -> DataFrame:
    """A row of pixel statistics for each file, deep ones for the share ``deep_rate``; errors are rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(PIXELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content, failed in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                deep = deep_rate >= 1 or (deep_rate > 0 and blake2b_number(path) / ((1 << 64) - 1) < deep_rate)
                unread = {"deep_statistics": deep, "status": "error", "error_type": "OSError", "error_message": failed}
                rows.append({"relative_path": path} | (unread if failed else pixel_record(content.as_py(), deep, hashed)))
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return contents_of(spark, root, paths).mapInArrow(run, PIXELS)


def encode(values: dict, pixels: np.ndarray | None = None, explicit: bool = True, syntax: str | None = None, fragments: list[bytes] | None = None) -> bytes:
    """A DICOM file of keyword values, for fixtures and exports: plain pixels, or fragments (the first is the offset table) under their ``syntax``."""
    number_of = {name: tag for tag, name in TAGS.items()}
    vr_of = {**{n: b"DS" for n in NUMBERS | VECTORS}, **{n: b"US" for n in WHOLE}, "InstanceNumber": b"IS", "StudyInstanceUID": b"UI", "SeriesInstanceUID": b"UI", "SOPInstanceUID": b"UI", "TransferSyntaxUID": b"UI", "NumberOfFrames": b"IS"}
    syntax = syntax or (EXPLICIT if explicit else IMPLICIT)
    order = ">" if syntax == BIG else "<"

    def element(tag, vr: bytes, raw: bytes, plain: bool, order: str = "<", size: int | None = None) -> bytes:
        raw += (b"\0" if vr in (b"UI", b"OW", b"OB") else b" ") * (len(raw) % 2)
        head, size = struct.pack(order + "HH", *tag), len(raw) if size is None else size
        if not plain:
            return head + struct.pack(order + "I", size) + raw
        return head + vr + (struct.pack(order + "HI", 0, size) if vr in LONG_VR else struct.pack(order + "H", size)) + raw

    def raw_of(vr: bytes, value) -> bytes:
        if vr == b"US":
            return struct.pack(order + "H", value)
        items = value if isinstance(value, (list, tuple)) else [value]
        return "\\".join(str(v) for v in items).encode()

    meta = element((2, 0x10), b"UI", syntax.encode(), True)
    body = b"".join(element(number_of[n], vr_of.get(n, b"LO"), raw_of(vr_of.get(n, b"LO"), values[n]), explicit, order) for n in sorted(values, key=number_of.get))
    if fragments is not None:
        padded = [f + b"\0" * (len(f) % 2) for f in fragments]
        items = b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(f)) + f for f in padded) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
        body += element(PIXEL_DATA, b"OB", items, True, size=0xFFFFFFFF)
    elif pixels is not None:
        body += element(PIXEL_DATA, b"OW", np.ascontiguousarray(pixels).astype(pixels.dtype.newbyteorder(order)).tobytes(), explicit, order)
    if syntax == DEFLATED:
        packer = zlib.compressobj(wbits=-15)
        body = packer.compress(body) + packer.flush()
    return b"\0" * 128 + b"DICM" + element((2, 0), b"UL", struct.pack("<I", len(meta)), True) + meta + body


__all__ = ["contents_of", "decoded", "deep_sample", "encode", "header_record", "header_schema", "list_files", "parse", "pixel_array", "pixel_record", "read_headers", "read_pixels"]
