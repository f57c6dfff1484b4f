"""S1, S5, S6 as a data source of Spark's: audio files listed folder by folder, and WAV windows by ranged reads.

For libraries on a file system that the driver and all executors mount. The driver lists only so many of the upper folders
as tasks are wanted; each task walks what is below its own. Excluded folders are never entered, and names that begin with a
dot or an underscore are seen.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import classify as C

AUDIO = (*C.LOSSLESS_EXT, *C.LOSSY_EXT)
SCHEMA = "path string, name string, ext string, length bigint, modificationTime timestamp"
#: Folders for each task that is wanted, before the driver stops looking into them.
FOLDERS_A_TASK = 4
BATCH = 4096


class Below(InputPartition):
    """Folders to walk, and folders of which only the files count."""

    def __init__(self, whole: list[str], flat: list[str]):
        self.whole, self.flat = whole, flat


def entries(folder: str) -> list[os.DirEntry]:
    try:
        with os.scandir(folder) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError:  # gone, or not ours to read
        return []


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.exclude = {e.strip().lower() for e in options.get("exclude", "").split("/") if e.strip()}
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.tasks = int(options.get("tasks", "16"))
        self.ext = set(options["kinds"].split("/")) if options.get("kinds") else set(AUDIO)
        self.least, self.most = int(options.get("least", "0")), float(options.get("most", "inf"))

    def _folders(self, folder: str) -> Iterator[str]:
        return (e.path for e in entries(folder) if e.name.lower() not in self.exclude and e.is_dir(follow_symlinks=False))

    def partitions(self) -> list[InputPartition]:
        """Folders are opened level by level until there are enough of them; then they are dealt out."""
        if not self.recursive:
            return [Below([], [self.root])]
        flat, whole = [], [self.root]
        while whole and len(whole) < self.tasks * FOLDERS_A_TASK:
            below = [f for folder in whole for f in self._folders(folder)]
            flat, whole = flat + whole, below
        n = max(1, min(self.tasks, len(whole) + len(flat)))
        return [Below(whole[i::n], flat[i::n]) for i in range(n)]

    def _files(self, folder: str) -> Iterator[tuple]:
        for e in entries(folder):
            ext = os.path.splitext(e.name)[1].lower()
            if ext in self.ext and e.is_file():
                try:
                    at = e.stat()
                except OSError:
                    continue
                if self.least <= at.st_size <= self.most:
                    yield e.path, e.name, ext, at.st_size, datetime.fromtimestamp(at.st_mtime, UTC)

    def read(self, partition: Below) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for folder in partition.flat:
                yield from self._files(folder)
            open_ = list(partition.whole)
            while open_:
                folder = open_.pop()
                yield from self._files(folder)
                open_ += self._folders(folder)

        rows: list[tuple] = []
        for row in each():
            rows.append(row)
            if len(rows) == BATCH:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "name", "ext", "length", "modificationTime"])


class AudioFiles(DataSource):
    """Options: path, exclude (folder names between slashes, in any case), recursive, tasks; kinds (extensions between slashes), least and most (bytes).

    Filters aren't pushed down by themselves: Spark keeps a reader's state between queries of one DataFrame, so what one
    query asked for would hold for the next.
    """

    @classmethod
    def name(cls) -> str:
        return "tonearm_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def listed(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), recursive: bool = True, tasks: int | None = None, kinds: tuple[str, ...] = (), least: int = 0, most: int | None = None) -> DataFrame:
    """Path, name, ext, length, modificationTime of the audio files below root; no file is opened. Links to folders aren't followed.

    kinds (extensions), least and most (bytes) are decided while listing; files of other kinds aren't asked for their size.
    """
    spark.dataSource.register(AudioFiles)
    wanted = tasks or spark.sparkContext.defaultParallelism * 2
    options = {"exclude": "/".join(exclude), "recursive": str(recursive).lower(), "tasks": wanted, "kinds": "/".join(k.lower() for k in kinds), "least": least, "most": "inf" if most is None else most}
    return spark.read.format("tonearm_files").options(**options).load(root)


# ---- WAV by ranges ---------------------------------------------------------------------------------------------------


def wav_layout(f) -> tuple[bytes, int, int]:
    """The format chunk, and where the samples of an open WAV file begin and how many bytes they are; only heads of chunks are read.

    A length of samples that the file doesn't have, as recorders leave it that were cut off or wrote more than 4 GB, is cut to the file's.
    """
    f.seek(0, os.SEEK_END)
    size = f.tell()
    f.seek(0)
    head = f.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        raise ValueError("no WAV file")
    form, at = None, 12
    while at + 8 <= size:
        f.seek(at)
        kind, length = struct.unpack("<4sI", f.read(8))
        if kind == b"data":
            if form is None:
                raise ValueError("no format before the samples")
            return form, at + 8, min(length, size - at - 8) if length < 0xFFFFFFFF else size - at - 8
        if kind == b"fmt ":
            form = f.read(min(length, 64))
        at += 8 + length + length % 2
    raise ValueError("no samples")


def wav_window(path: str, start: float, seconds: float) -> bytes:
    """A WAV file of its own with the samples from start on: only they and heads of chunks are read, whatever the file's size."""
    with open(path.removeprefix("file://").removeprefix("file:"), "rb") as f:
        form, at, length = wav_layout(f)
        rate, block = struct.unpack_from("<I", form, 4)[0], struct.unpack_from("<H", form, 12)[0]
        first = min(int(start * rate) * block, length)
        f.seek(at + first)
        data = f.read(min(int(seconds * rate) * block, (length - first) // block * block))
    body = b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def wav_windows(files: DataFrame, path: str = "path", start: str = "start", seconds: str = "seconds") -> DataFrame:
    """Rows (path, start, seconds) with content, the window as a WAV file, or error. Windows stay with their files' rows; nothing else of a file is read."""
    at = [files.columns.index(c) for c in (path, start, seconds)]
    schema = files.withColumns({"content": F.lit(None).cast("binary"), "error": F.lit(None).cast("string")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a window can be large: one a batch
                row = batch.slice(i, 1)
                p, s, n = (row.column(j)[0].as_py() for j in at)
                try:
                    content, error = wav_window(p, s, n), None
                except (OSError, ValueError, TypeError, AttributeError, struct.error) as e:
                    content, error = None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary()), pa.array([error], pa.string())], names=[*batch.schema.names, "content", "error"])

    return files.mapInArrow(run, schema)


def _with_rows(files: DataFrame, path: str, columns: str, one) -> DataFrame:
    """files with the columns that one(open file) gives for each path; the last of them is the error of what can't be read."""
    at, fields = files.columns.index(path), [c.split() for c in columns.split(", ")]
    schema = files.limit(0).selectExpr("*", *(f"cast(null as {kind}) as {name}" for name, kind in fields)).schema

    def read(p: str | None) -> tuple:
        try:
            with open(p.removeprefix("file://").removeprefix("file:"), "rb") as f:
                return one(f)
        except Exception as e:  # any broken file becomes a row with its error
            return (*[None] * (len(fields) - 1), f"{type(e).__name__}: {e}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"int": pa.int32(), "double": pa.float64(), "bigint": pa.int64(), "long": pa.int64(), "string": pa.string()}
        for batch in batches:
            found = list(zip(*map(read, batch.column(at).to_pylist()), strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, kinds[k]) for v, (_, k) in zip(found, fields, strict=True))], names=[*batch.schema.names, *(n for n, _ in fields)])

    return files.mapInArrow(run, schema)


def _head(f) -> tuple[int, int, int]:
    form, _, length = wav_layout(f)
    channels, rate, _, block = struct.unpack_from("<HIIH", form, 2)
    return rate, channels, length // block


def wav_info(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with samplerate, channels, duration, frames of WAV files by their heads alone, or error."""

    def one(f) -> tuple:
        rate, channels, frames = _head(f)
        return rate, channels, frames / rate, frames, None

    return _with_rows(files, path, "samplerate int, channels int, duration double, frames bigint, error string", one)


def wav_features(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with the features of audio.FEATURES; of each file only heads of chunks and the windows that are measured are read."""
    from ..functions import audio

    def one(f) -> tuple:
        return audio.measured(*_head(f), lambda start, length: audio.read_wav(wav_window(f.name, start, length))[1])

    return _with_rows(files, path, audio.FEATURES, one)
