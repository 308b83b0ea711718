"""Header scans by byte ranges, and encapsulated pixels of files encoded here."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiolith import stages
from radiolith.operators import files
from radiolith.sources import codecs, dicom, images, ranged

HEAD = {"StudyInstanceUID": "S", "SeriesInstanceUID": "E", "SOPInstanceUID": "o", "PatientID": "secret", "InstanceNumber": 1, "Manufacturer": "SIEMENS", "ImageOrientationPatient": [1, 0, 0, 0, 1, 0], "ImagePositionPatient": [0, 0, 2.5]}


def head_of(image, **more):
    frames = image.shape[0] if image.ndim == 4 else 1
    rows, columns = image.shape[-3:-1] if image.ndim > 2 else image.shape
    samples = image.shape[-1] if image.ndim > 2 else 1
    bits = 8 * image.dtype.itemsize
    return HEAD | {"Rows": rows, "Columns": columns, "SamplesPerPixel": samples, "BitsAllocated": bits, "BitsStored": bits, "HighBit": bits - 1, "PixelRepresentation": int(image.dtype.kind == "i")} | ({"NumberOfFrames": frames} if frames > 1 else {}) | more


# --- encoders, the plain way ---------------------------------------------------------------------------------------


def pack_bits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        run = 1
        while run < 128 and i + run < len(raw) and raw[i + run] == raw[i]:
            run += 1
        if run > 1:
            out += bytes([257 - run, raw[i]])
            i += run
        else:
            j = i + 1
            while j < len(raw) and j - i < 128 and (j + 1 >= len(raw) or raw[j] != raw[j + 1]):
                j += 1
            out += bytes([j - i - 1]) + raw[i:j]
            i = j
    return bytes(out) + (b"\x80" if len(out) % 2 else b"")


def rle(image: np.ndarray) -> bytes:
    image = image.reshape(*image.shape[:2], -1)
    big = image.astype(image.dtype.newbyteorder(">"))
    planes = [np.ascontiguousarray(big[..., s]).view(np.uint8).reshape(*image.shape[:2], -1)[..., k].tobytes() for s in range(image.shape[2]) for k in range(image.dtype.itemsize)]
    segments = [pack_bits(p) for p in planes]
    offsets = [64 + sum(map(len, segments[:k])) for k in range(len(segments))]
    return struct.pack("<16I", len(segments), *offsets, *[0] * (15 - len(segments))) + b"".join(segments)


def jpeg(image: np.ndarray, predictor: int = 1, restart: int = 0, precision: int = 16) -> bytes:
    x = image.reshape(*image.shape[:2], -1).astype(int) & 0xFFFF
    rows, columns, samples = x.shape
    bits = []
    coded = b""
    marker = 0

    def flush():
        nonlocal bits
        bits += ["1"] * (-len(bits) % 8)
        text = "".join(bits)
        bits = []
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")

    begin = 0
    for k in range(rows * columns):
        if restart and k and k % restart == 0:
            coded += flush() + bytes([0xFF, 0xD0 + marker % 8])
            marker, begin = marker + 1, k
        r, c = divmod(k, columns)
        for s in range(samples):
            if k == begin:
                guess = 1 << (precision - 1)
            elif r == begin // columns:
                guess = x[r, c - 1, s]
            elif c == 0:
                guess = x[r - 1, c, s]
            else:
                a, b, d = x[r, c - 1, s], x[r - 1, c, s], x[r - 1, c - 1, s]
                guess = (a, b, d, a + b - d, a + ((b - d) >> 1), b + ((a - d) >> 1), (a + b) >> 1)[predictor - 1]
            difference = (int(x[r, c, s]) - int(guess) + 32767) % 65536 - 32767
            size = 16 if difference == 32768 else abs(difference).bit_length()
            bits += format(size, "05b")  # 17 codes of 5 bits
            if 0 < size < 16:
                bits += format(difference if difference > 0 else difference + (1 << size) - 1, f"0{size}b")
    coded += flush()
    table = bytes([0]) + bytes([0] * 4 + [17] + [0] * 11) + bytes(range(17))
    segment = lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xC4, table) + segment(0xC3, struct.pack(">BHHB", precision, rows, columns, samples) + b"".join(bytes([i + 1, 0x11, 0]) for i in range(samples)))
    if restart:
        out += segment(0xDD, struct.pack(">H", restart))
    return out + segment(0xDA, bytes([samples]) + b"".join(bytes([i + 1, 0]) for i in range(samples)) + bytes([predictor, 0, 0])) + coded + b"\xff\xd9"


def picture(shape=(33, 41), kind=np.int16, seed=3, low=-900, high=900):
    rng = np.random.default_rng(seed)
    smooth = np.add.outer(np.arange(shape[0]) * 5, np.arange(shape[1]) * 3)
    x = smooth.reshape(*shape[:2], *[1] * (len(shape) - 2)) + rng.integers(-20, 20, size=shape)
    x[5:12, 7:20] = high
    x[0, 0], x[-1, -1] = low, high
    return x.astype(kind)


@pytest.mark.parametrize("kind, shape", [(np.uint16, (33, 41)), (np.int16, (33, 41)), (np.uint8, (20, 30)), (np.uint8, (20, 30, 3)), (np.int32, (9, 7))])
def test_run_lengths(kind, shape):
    image = picture(shape, kind, low=0 if np.dtype(kind).kind == "u" else -100, high=200)
    data = dicom.encode(head_of(image), syntax=codecs.RLE, fragments=[b"", rle(image)])
    got, _, _, decoder, tried = dicom.decoded(data)
    assert (got == image).all() and got.dtype == image.dtype and decoder == "rle_by_runs" and tried == ["rle_by_runs"]
    plain = codecs.rle_by_bytes(rle(image), (*shape[:2], shape[2] if len(shape) > 2 else 1), 8 * image.dtype.itemsize)
    assert (plain.astype(f"u{image.dtype.itemsize}").view(kind).reshape(shape) == image).all()


@pytest.mark.parametrize("predictor, restart, decoder", [(1, 0, "jpeg_by_jumps"), (2, 0, "jpeg_by_jumps"), (4, 0, "jpeg_by_jumps"), (3, 0, "jpeg_by_symbols"), (5, 0, "jpeg_by_symbols"), (6, 0, "jpeg_by_symbols"), (7, 0, "jpeg_by_symbols"), (1, 82, "jpeg_by_symbols")])
def test_lossless_jpeg(predictor, restart, decoder):
    for image in (picture(), picture(kind=np.uint16, low=0, high=65535), np.random.default_rng(1).integers(0, 65536, (17, 19)).astype(np.uint16), np.zeros((4, 5), np.uint16)):
        coded = jpeg(image, predictor, restart)
        data = dicom.encode(head_of(image), syntax=codecs.JPEG_LOSSLESS, fragments=[b"", coded[:100], coded[100:]] if len(coded) > 200 else [b"", coded])
        got, _, _, used, tried = dicom.decoded(data)
        assert (got == image).all() and got.dtype == image.dtype and used == decoder
        assert tried == (["jpeg_by_jumps"] if decoder == "jpeg_by_jumps" else ["jpeg_by_jumps", "jpeg_by_symbols"])
        assert (codecs.jpeg_by_symbols(coded, (*image.shape, 1), 16).reshape(image.shape) == image.view(np.uint16)).all()


def test_lossless_jpeg_of_colours_falls_back():
    image = picture((12, 10, 3), np.uint8, low=0, high=255)
    data = dicom.encode(head_of(image), syntax=codecs.JPEG_LOSSLESS_FIRST_ORDER, fragments=[b"", jpeg(image, precision=8)])
    got, _, _, used, _ = dicom.decoded(data)
    assert (got == image).all() and used == "jpeg_by_symbols"


def test_frames_by_offset_table_and_by_fragment():
    frames = [picture(seed=k) for k in range(3)]
    coded = [jpeg(f) for f in frames]
    coded = [c + b"\0" * (len(c) % 2) for c in coded]
    halves = [part for c in coded for part in (c[:50], c[50:])]
    offsets = [sum(len(h) + 8 for h in halves[: 2 * k]) for k in range(3)]
    head = head_of(frames[0], NumberOfFrames=3)
    for fragments in ([struct.pack("<3I", *offsets), *halves], [b"", *coded]):
        got = dicom.decoded(dicom.encode(head, syntax=codecs.JPEG_LOSSLESS_FIRST_ORDER, fragments=fragments))[0]
        assert (got == np.stack(frames)).all()
    bad = dicom.pixel_record(dicom.encode(head, syntax=codecs.JPEG_LOSSLESS_FIRST_ORDER, fragments=[b"", *halves]), deep=False)
    assert bad["status"] == "error" and "6 fragments for 3 frames" in bad["error_message"]


@pytest.mark.parametrize("syntax", [dicom.BIG, dicom.DEFLATED, dicom.EXPLICIT])
def test_plain_syntaxes(syntax):
    image = picture(kind=np.int16)
    data = dicom.encode(head_of(image, RescaleSlope=2), image, syntax=syntax)
    got, slope, _, decoder, _ = dicom.decoded(data)
    assert (got == image).all() and (slope, decoder) == (2.0, "plain")
    assert dicom.header_record(data)["Rows"] == 33
    assert dicom.pixel_record(data, False)["pixel_sha256"] == dicom.pixel_record(dicom.encode(head_of(image), image), False)["pixel_sha256"]


def test_what_neither_decoder_reads_names_both_errors():
    image = picture()
    for syntax, coded, names in ((codecs.RLE, rle(image)[:300], ("rle_by_runs", "rle_by_bytes")), (codecs.JPEG_LOSSLESS, jpeg(image)[:400], ("jpeg_by_jumps", "jpeg_by_symbols"))):
        row = dicom.pixel_record(dicom.encode(head_of(image), syntax=syntax, fragments=[b"", coded]), deep=False)
        assert row["status"] == "error" and all(n in row["error_message"] for n in names)
    row = dicom.pixel_record(dicom.encode(head_of(image), syntax="1.2.840.10008.1.2.4.90", fragments=[b"", b"xx"]), deep=False)
    assert row["status"] == "error" and "1.2.840.10008.1.2.4.90" in row["error_message"]
    for cut in range(0, len(jpeg(image)), 37):
        dicom.pixel_record(dicom.encode(head_of(image), syntax=codecs.JPEG_LOSSLESS, fragments=[b"", jpeg(image)[:cut]]), deep=False)


def test_ranges_are_fetched_as_asked():
    data = bytes(np.random.default_rng(0).integers(0, 256, 100_000, dtype=np.uint8))
    asked = []
    part = ranged.RangedBytes(lambda at, n: asked.append((at, n)) or data[at : at + n], len(data), first=64)
    assert part[10:20] == data[10:20] and part[0:5] == data[0:5] and part[60:300] == data[60:300] and part[90_000:90_004] == data[90_000:90_004] and part[99_990:200_000] == data[99_990:]
    assert part[200_000:200_010] == b"" and part.fetched == sum(n for _, n in asked) < 20_000


# --- the scan ------------------------------------------------------------------------------------------------------


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "dicom"
    image = picture((400, 400), np.int16)
    for study in range(6):
        folder = root / f"S{study}" / "a folder"
        folder.mkdir(parents=True)
        for i in range(4):
            data = dicom.encode(head_of(image, StudyInstanceUID=f"S{study}", InstanceNumber=i), image, explicit=bool(i % 2))
            if i == 3:  # a large private element before the kept ones is stepped over
                at = data.index(struct.pack("<HH", 0x20, 0x0D))
                data = data[:at] + struct.pack("<HH", 0x19, 0x1001) + b"OB\0\0" + struct.pack("<I", 150_000) + b"\1" * 150_000 + data[at:]
            (folder / f"{i}.dcm").write_bytes(data)
    (root / "S0" / "bad.dcm").write_bytes(b"not dicom at all")
    (root / "S0" / "empty.dcm").write_bytes(b"")
    (root / ".hidden").mkdir()
    (root / ".hidden" / "_x").write_bytes(b"x")
    return root


def test_scan_reads_little_and_only_its_shards(spark, corpus, tmp_path):
    audit = str(tmp_path / "audit")
    stages.index(spark, str(corpus), audit, 4)
    rows = ranged.scan_headers(spark, files._qualified(spark, str(corpus)), files._qualified(spark, f"{audit}/index/files"), files_each=2)
    total = rows.agg(F.sum("bytes_fetched"), F.sum("file_size_bytes"), F.count_if(F.col("status") == "ok"), F.count("*")).first()
    assert total[0] < 0.05 * total[1] and (total[2], total[3]) == (24, 26)
    index = files.read_index(spark, f"{audit}/index")
    shard = index.groupBy("shard").count().orderBy("shard").first()[0]
    own = {r[0] for r in index.where(F.col("shard") == shard).select("relative_path").collect()}
    for gone in set(r[0] for r in index.select("relative_path").collect()) - own:
        (corpus / gone).unlink()  # files of other shards aren't opened
    for condition in (F.col("shard") == shard, F.col("shard").isin([shard, 77]), (F.col("shard") == shard) & (F.col("file_size_bytes") >= 0)):
        got = rows.where(condition)
        assert {r["relative_path"] for r in got.collect()} == own and got.where("error_type like '%NotFound%'").count() == 0
    gone = dicom.read_headers(spark, str(corpus), "salt", index=f"{audit}/index/files")
    assert gone.where("status = 'error' and error_type = 'FileNotFoundError'").count() == 26 - len(own)


def test_ranged_rows_equal_whole_rows(spark, corpus):
    ranged_rows = {r["relative_path"]: r for r in dicom.read_headers(spark, str(corpus), "salt").drop("header_seconds").collect()}
    whole = {r["relative_path"]: r for r in dicom.with_geometry(dicom._whole_headers(spark, str(corpus), None), "salt").drop("header_seconds").collect()}
    assert ranged_rows == whole and len(whole) == 26 and "PatientID" not in ranged_rows["S1/a folder/0.dcm"].asDict()
    some = spark.createDataFrame([("S1/a folder/0.dcm",), ("S1/a folder/0.dcm",), ("S9/none.dcm",), (None,)], "relative_path string")
    got = {r["relative_path"]: r["status"] for r in dicom.read_headers(spark, str(corpus), "salt", some).collect()}
    assert got == {"S1/a folder/0.dcm": "ok", "S9/none.dcm": "error"}
    assert dicom.read_headers(spark, str(corpus), "salt", some.limit(0)).count() == 0
    pixels = {r["relative_path"]: r for r in dicom.read_pixels(spark, str(corpus), paths=some).collect()}
    assert pixels["S1/a folder/0.dcm"]["decoder"] == "plain" and pixels["S9/none.dcm"]["status"] == "error"


def test_hidden_files_are_listed_in_tasks(spark, corpus):
    got = {r["relative_path"]: r["size_bytes"] for r in files.list_files(spark, str(corpus), include_hidden=True).collect()}
    seen = {r["relative_path"]: r["size_bytes"] for r in files.list_files(spark, str(corpus)).collect()}
    assert got == seen | {".hidden/_x": 1} and len(seen) == 26


def test_windows_of_compressed_slices(spark, tmp_path):
    image = picture((16, 16), np.uint16, low=0)
    (tmp_path / "a.dcm").write_bytes(dicom.encode(head_of(image), image))
    (tmp_path / "b.dcm").write_bytes(dicom.encode(head_of(image), syntax=codecs.RLE, fragments=[b"", rle(image)]))
    windows = spark.createDataFrame([("S", 0, ["a.dcm", "b.dcm", "none.dcm"])], "study_id string, window_index int, paths array<string>")
    a, b, none = images.load_windows(spark, str(tmp_path), windows, 8).first()["channels"]
    assert a == b and max(a) > 0 and max(none) == 0
