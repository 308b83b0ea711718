"""Files by byte ranges: a header scan as a data source whose partitions are slices of a file index.

A slice names its files and their sizes; a header is fetched in blocks that grow until the pixels begin, and a large element
on the way is stepped over.  A filter on ``shard`` is taken over by the source, so other shards' files are not opened.  Whole files, for pixels, are read by the tasks that hold their
paths.  Files come through Arrow's file systems (local, HDFS, object stores); where those don't reach, ``reaches`` says so and Spark's own reader is used.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Bytes of the first block, and the most that a block grows to.
FIRST_BLOCK = 4096
LARGEST_BLOCK = 1 << 20
#: Files in a partition, and files that a task waits for at a time.
FILES_EACH = 2048
AT_ONCE = 8


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a qualified path, and the path in it."""
    if match := re.fullmatch(r"file:/{0,3}(/.*)", uri):
        return pafs.LocalFileSystem(), match[1]
    return pafs.FileSystem.from_uri(uri)


def reaches(uri: str) -> bool:
    """Whether Arrow can list the folder at ``uri``."""
    try:
        system, path = file_system(uri)
        return system.get_file_info(path).type != pafs.FileType.NotFound
    except Exception:  # an unknown scheme, a library that isn't there
        return False


class RangedBytes:
    """A file of known size whose slices are fetched as they are asked for."""

    def __init__(self, fetch: Callable[[int, int], bytes], size: int, first: int = FIRST_BLOCK):
        self._fetch, self._size, self._step = fetch, size, first
        self._at, self._held = 0, b""
        self.fetched = 0

    def __len__(self) -> int:
        return self._size

    def __getitem__(self, part: slice) -> bytes:
        a, b, _ = part.indices(self._size)
        if a >= b:
            return b""
        end = self._at + len(self._held)
        if not self._at <= a <= end:  # elsewhere: what is held is of no use
            self._at, self._held, end = a, b"", a
        if b > end:
            size = min(max(b - end, self._step), self._size - end)
            more = self._fetch(end, size)
            self.fetched += len(more)
            self._held, self._at = self._held[a - self._at :] + more, a
            self._step = min(2 * self._step, LARGEST_BLOCK)
        return self._held[a - self._at : b - self._at]


class _Slice(InputPartition):
    def __init__(self, path: str, shard: int | None, first: int, rows: int):
        super().__init__((path, first))
        self.path, self.shard, self.first, self.rows = path, shard, first, rows


class HeaderReader(DataSourceReader):
    """Slices of an index as partitions; see :class:`HeaderSource`."""

    def __init__(self, schema, options):
        self.arrow_schema = _arrow_schema(schema)
        self.root, self.index = options["root"], options["index"]
        self.first, self.each = int(options.get("firstBlock", FIRST_BLOCK)), int(options.get("filesEach", FILES_EACH))
        self.shards: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("shard",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.shards = wanted if self.shards is None else self.shards & wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, path = file_system(self.index)
        out: list[InputPartition] = []
        for info in sorted(system.get_file_info(pafs.FileSelector(path, recursive=True)), key=lambda i: i.path):
            if info.type != pafs.FileType.File or not info.path.endswith(".parquet"):
                continue
            found = re.search(r"/shard=(\d+)/", info.path)
            shard = int(found[1]) if found else None
            if self.shards is not None and shard is not None and shard not in self.shards:
                continue
            with system.open_input_file(info.path) as f:
                rows = pq.ParquetFile(f).metadata.num_rows
            out += [_Slice(info.path, shard, a, min(self.each, rows - a)) for a in range(0, rows, self.each)]
        return out

    def _files(self, part: _Slice) -> Iterator[tuple[str, int | None, int | None]]:
        system, _ = file_system(self.index)
        at = 0
        with system.open_input_file(part.path) as f:
            table = pq.ParquetFile(f)
            names = [n for n in ("relative_path", "size_bytes", "shard") if n in table.schema_arrow.names]
            for k in range(table.num_row_groups):
                rows = table.metadata.row_group(k).num_rows
                a, b = max(part.first - at, 0), min(part.first + part.rows - at, rows)
                if a < b:
                    own = table.read_row_group(k, columns=names).slice(a, b - a)
                    n = len(own)
                    columns = [own.column(c).to_pylist() if c in names else [None] * n for c in ("relative_path", "size_bytes", "shard")]
                    yield from ((p, s, part.shard if part.shard is not None else d) for p, s, d in zip(*columns))
                at += rows

    def read(self, part: _Slice | None) -> Iterator[pa.RecordBatch]:
        from .dicom import header_record

        if part is None:  # what a source without partitions is asked for
            return
        system, base = file_system(self.root)
        names = set(self.arrow_schema.names)

        def one(entry: tuple[str, int | None, int | None]) -> dict:
            path, size, shard = entry
            began, fetched = time.perf_counter(), 0
            try:
                with system.open_input_file(f"{base.rstrip('/')}/{path}") as f:
                    source = RangedBytes(lambda at, n: f.read_at(n, at), f.size() if size is None else size, self.first)
                    row = header_record(source)
                    size, fetched = len(source), source.fetched
            except Exception as error:  # a file that is gone or refused is a row, as one that can't be parsed
                row = {"status": "error", "error_type": type(error).__name__, "error_message": str(error)[:1000]}
            row = {k: v for k, v in row.items() if k in names}
            return row | {"relative_path": path, "file_size_bytes": size, "shard": shard, "bytes_fetched": fetched, "header_seconds": time.perf_counter() - began}

        batch: list[tuple[str, int | None, int | None]] = []
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for entry in self._files(part):
                if self.shards is not None and entry[2] not in self.shards:
                    continue
                batch.append(entry)
                if len(batch) == 256:
                    yield pa.RecordBatch.from_pylist(list(pool.map(one, batch)), schema=self.arrow_schema)
                    batch = []
            if batch:
                yield pa.RecordBatch.from_pylist(list(pool.map(one, batch)), schema=self.arrow_schema)


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class HeaderSource(DataSource):
    """Format ``dicom_headers``.  Options: ``root`` (the corpus, qualified), ``index`` (a folder of Parquet files with relative_path and, if known, size_bytes and
    shard, as a column or as partitions), ``firstBlock``, ``filesEach``."""

    @classmethod
    def name(cls) -> str:
        return "dicom_headers"

    def schema(self):
        from .dicom import header_schema

        return header_schema()

    def reader(self, schema) -> DataSourceReader:
        return HeaderReader(schema, self.options)


def scan_headers(spark, root: str, index: str, first_block: int = FIRST_BLOCK, files_each: int = FILES_EACH) -> DataFrame:
    """The headers of an index' files as a table with ``shard`` and ``bytes_fetched``; filters on ``shard`` reach the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HeaderSource)
    return spark.read.format("dicom_headers").option("root", root).option("index", index).option("firstBlock", first_block).option("filesEach", files_each).load()


def contents(paths: DataFrame, root: str, each: int = 64) -> DataFrame:
    """relative_path, length and content of the files of ``paths``, read by the tasks that hold the paths; a file that can't be read has no content and says why in ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)

        def one(path: str):
            try:
                with system.open_input_file(f"{base.rstrip('/')}/{path}") as f:
                    return f.read(), None
            except Exception as error:
                return None, f"{type(error).__name__}: {error}"[:1000]

        with ThreadPoolExecutor(AT_ONCE) as pool:
            for batch in batches:
                names = batch.column(0).to_pylist()
                for a in range(0, len(names), AT_ONCE):
                    got = list(pool.map(one, names[a : a + AT_ONCE]))
                    data = [d for d, _ in got]
                    yield pa.RecordBatch.from_arrays([pa.array(names[a : a + AT_ONCE]), pa.array([None if d is None else len(d) for d in data], pa.int64()), pa.array(data, pa.binary()), pa.array([e for _, e in got], pa.string())], ["relative_path", "length", "content", "error"])

    return paths.select("relative_path").mapInArrow(run, "relative_path string, length long, content binary, error string")


def children(folders: DataFrame, root: str) -> DataFrame:
    """What lies directly in each folder: relative_path, size_bytes, mtime_us, is_folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        base = base.rstrip("/")
        names = ["relative_path", "size_bytes", "mtime_us", "is_folder"]
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                infos = system.get_file_info(pafs.FileSelector(f"{base}/{folder}".rstrip("/")))
                for a in range(0, len(infos), 8192):
                    some = infos[a : a + 8192]
                    columns = ([i.path[len(base) + 1 :] for i in some], [i.size if i.is_file else None for i in some], [(i.mtime_ns or 0) // 1000 for i in some], [i.type == pafs.FileType.Directory for i in some])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.bool_()))], names)

    return folders.select("relative_path").mapInArrow(run, "relative_path string, size_bytes long, mtime_us long, is_folder boolean")
