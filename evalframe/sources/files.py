"""Trees of files as a Python data source: ``filetree``.

Reading lists a tree once, on the driver, and plans partitions as lists of paths of
about equal bytes; tasks open their files through Arrow's file systems and stream
them in pieces, so that a file of any length is hashed, or read in pieces, in
bounded memory. A root that does not exist has no files. Writing makes one file for
each row: each is written beside its place and moved there when it is whole, so that
a task that runs twice leaves the same files.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: What is read of each file.
SCHEMAS = {
    "list": "path string, length long",
    "checksum": "path string, length long, checksum string",
    "content": "path string, length long, content binary",
    "pieces": "path string, length long, offset long, content binary",
}
ALGORITHMS = ("sha256", "md5", "sha1")
#: Bytes of a partition and of a piece, about, and what opening a file costs in bytes.
PARTITION_BYTES, PIECE_BYTES, OPEN_BYTES = 128 << 20, 8 << 20, 1 << 20
#: Paths of a partition at most where files are only listed; bytes that a content column can hold.
LISTED, CONTENT_LIMIT = 50_000, (1 << 31) - 1
_UNFINISHED = ".writing-"
_ARROW = {"path": pa.string(), "length": pa.int64(), "checksum": pa.string(), "offset": pa.int64(), "content": pa.binary()}


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a location, and the path in it; a location without a scheme is a local one."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri.rstrip("/") or "/"
    scheme, rest = uri.split(":", 1)
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.strip("/")
    found, path = pafs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{rest}")
    return found, path.rstrip("/")


def listed(uri: str) -> list[tuple[str, int]]:
    """(path from the root, bytes) of all files under a root by path; none if there is no such root."""
    files, root = file_system(uri)
    found = files.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
    return sorted((f.path[len(root) :].lstrip("/"), f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(_UNFINISHED))


@dataclass
class Files(InputPartition):
    """Parts of files: path, length, and the range of bytes that is read."""

    parts: list[tuple[str, int, int, int]]


def planned(files: list[tuple[str, int]], read: str, partition_bytes: int, piece_bytes: int) -> list[Files]:
    """Partitions of about ``partition_bytes`` each; files that are read in pieces are cut at these where they are larger."""
    if read == "list":
        return [Files([(p, n, 0, n) for p, n in files[i : i + LISTED]]) for i in range(0, len(files), LISTED)]
    step = max(partition_bytes // piece_bytes, 1) * piece_bytes
    out, now, cost = [], [], 0
    for path, length in files:
        ranges = [(lo, min(lo + step, length)) for lo in range(0, length, step)] if read == "pieces" and length > step else [(0, length)]
        for lo, hi in ranges:
            if now and cost + OPEN_BYTES + hi - lo > partition_bytes:
                out.append(Files(now))
                now, cost = [], 0
            now.append((path, length, lo, hi))
            cost += OPEN_BYTES + hi - lo
    return [*out, Files(now)] if now else out


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.root, self.kind = options["path"], options.get("read", "list")
        self.algorithm = options.get("algorithm", "sha256")
        self.partition_bytes, self.piece_bytes = int(options.get("partitionBytes", PARTITION_BYTES)), int(options.get("pieceBytes", PIECE_BYTES))
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"unsupported algorithm: {self.algorithm}")

    def partitions(self) -> list[Files]:
        return planned(listed(self.root), self.kind, self.partition_bytes, self.piece_bytes) or [Files([])]

    def _rows(self, partition: Files) -> Iterator[tuple[int, tuple]]:
        """Each row with the bytes that it holds."""
        files, root = file_system(self.root)
        for path, length, lo, hi in partition.parts:
            if self.kind == "list":
                yield len(path), (path, length)
                continue
            if self.kind == "content" and length > CONTENT_LIMIT:
                raise ValueError(f"{path} has {length} bytes; read it in pieces")
            with files.open_input_file(f"{root}/{path}") as f:
                if self.kind == "content":
                    yield length, (path, length, f.read())
                elif self.kind == "checksum":
                    h = hashlib.new(self.algorithm)
                    while piece := f.read(self.piece_bytes):
                        h.update(piece)
                    yield len(path), (path, length, h.hexdigest())
                else:
                    f.seek(lo)
                    for at in range(lo, max(hi, lo + 1), self.piece_bytes):
                        piece = f.read(min(self.piece_bytes, hi - at))
                        yield len(piece), (path, length, at, piece)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMAS[self.kind].split(", ")]
        schema = pa.schema([(n, _ARROW[n]) for n in names])
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, _ARROW[n]) for n, c in zip(names, zip(*rows))], schema=schema)
        rows, size = [], 0
        for n, row in self._rows(partition):
            rows.append(row)
            size += n
            if size >= self.piece_bytes or len(rows) >= 10_000:
                yield make(rows)
                rows, size = [], 0
        if rows:
            yield make(rows)


class _Writer(DataSourceArrowWriter):
    """One file for each row of ``folder``, ``name`` and ``value`` (text or binary)."""

    def __init__(self, options: Mapping[str, str]):
        self.root = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = file_system(self.root)
        made: set[str] = set()
        for b in iterator:
            for folder, name, value in zip(*(b[c].to_pylist() for c in ("folder", "name", "value"))):
                if not name or "/" in name or name in (".", "..") or ".." in (folder or "").split("/"):
                    raise ValueError(f"not a file's name: {folder}/{name}")
                at = f"{root}/{folder}" if folder else root
                if at not in made:
                    files.create_dir(at, recursive=True)
                    made.add(at)
                own = f"{at}/{_UNFINISHED}{uuid.uuid4().hex}"
                with files.open_output_stream(own) as f:
                    f.write(value.encode() if isinstance(value, str) else value or b"")
                files.move(own, f"{at}/{name}")
        return WriterCommitMessage()


class FileTree(DataSource):
    """``spark.read.format("filetree").option("read", kind).load(root)`` and ``df.write.format("filetree").mode("append").save(root)``.

    Options: read (list, checksum, content, pieces), algorithm (sha256, md5, sha1), partitionBytes, pieceBytes. Paths are
    relative to the root. An empty file has one empty piece.
    """

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("read", "list")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("files are only added")
        return _Writer(self.options)


def _options(extra: dict) -> dict:
    names = {"partition_bytes": "partitionBytes", "piece_bytes": "pieceBytes"}
    return {names.get(k, k): str(v) for k, v in extra.items() if v is not None}


def scan_tree(spark: SparkSession, root: str, read: str = "list", **options) -> DataFrame:
    """The files under a root, by path from it; no rows if the root does not exist. ``read``: list, checksum, content or pieces."""
    if read not in SCHEMAS:
        raise ValueError(f"unknown kind: {read}")
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").options(read=read, **_options(options)).load(root)


def write_tree(df: DataFrame, root: str) -> None:
    """Adds a file for each row: ``value`` (text or binary) in ``folder``, under ``name``. Of rows with one place, one stays."""
    df.sparkSession.dataSource.register(FileTree)
    df.select("folder", "name", "value").write.format("filetree").mode("append").save(root)
