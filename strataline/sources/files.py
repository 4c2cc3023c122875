"""Files of any filesystem URI: listing, atomic writes, ordered single-file output of a DataFrame."""

from __future__ import annotations

import contextlib
import hashlib
import itertools
import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

REPORTS = ("migration_report.jsonl", "migration_report.csv", "reconstruction_report.jsonl", "verification_report.json", "quality_report.json", "checksum_manifest.json")


def at(path: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path of a URI or local path."""
    path = str(path)
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def exists(path: str) -> bool:
    filesystem, p = at(path)
    return filesystem.get_file_info(p).type != fs.FileType.NotFound


def read_bytes(path: str, size: int | None = None) -> bytes:
    filesystem, p = at(path)
    with filesystem.open_input_stream(p, compression=None) as f:
        return f.read(size) if size is not None else f.read()


def size(path: str) -> int:
    filesystem, p = at(path)
    return filesystem.get_file_info(p).size or 0


def sha256(path: str) -> str:
    filesystem, p = at(path)
    state = hashlib.sha256()
    with filesystem.open_input_stream(p, compression=None) as f:
        while block := f.read(1 << 20):
            state.update(block)
    return state.hexdigest()


def listed(root: str) -> list[str]:
    """Relative paths of all files under root (or the one file), in order of their lower-case form."""
    filesystem, p = at(root)
    info = filesystem.get_file_info(p)
    if info.type == fs.FileType.File:
        return [PurePosixPath(p).name]
    found = filesystem.get_file_info(fs.FileSelector(p, recursive=True, allow_not_found=True))
    names = [str(PurePosixPath(i.path).relative_to(p)) for i in found if i.type == fs.FileType.File]
    return sorted(names, key=lambda n: (n.lower(), n))


def root_of(source: str) -> str:
    """The folder of a source that may be one file."""
    filesystem, p = at(source)
    return str(PurePosixPath(str(source)).parent) if filesystem.get_file_info(p).type == fs.FileType.File else str(source)


@dataclass(frozen=True)
class FoundTable:
    path: str
    relative: str
    memo: str | None
    index: str | None

    @property
    def name(self) -> str:
        return PurePosixPath(self.relative).stem


def discover_tables(source: str) -> list[FoundTable]:
    """Tables under source with their memo and index files, found whatever the case of their names."""
    root, names = root_of(source), listed(source)
    beside = {n.lower(): n for n in (names if root == str(source) else listed(root))}
    out = []
    for n in names:
        if not n.lower().endswith(".dbf"):
            continue
        memo, index = (beside.get(n[:-4].lower() + e) for e in (".fpt", ".cdx"))
        out.append(FoundTable(f"{root}/{n}", n, memo and f"{root}/{memo}", index and f"{root}/{index}"))
    return out


def discover_inputs(source: str, suffix: str) -> list[str]:
    """Exported data files of a format: no reports, sidecars or separated deleted rows."""
    keep = lambda n: PurePosixPath(n).name not in REPORTS and not PurePosixPath(n).stem.endswith(("_schema", ".deleted"))
    return [n for n in listed(source) if n.lower().endswith("." + suffix) and keep(n)]


def safe_relative(path: str) -> str:
    """path, if it is relative and stays below its root; else ValueError."""
    parts = PurePosixPath(path).parts
    if not parts or PurePosixPath(path).is_absolute() or ".." in parts:
        raise ValueError(f"unsafe path: {path}")
    return path


def ensure_free(path: str, overwrite: bool) -> None:
    if not overwrite and exists(path):
        raise FileExistsError(path)


def write_atomic(path: str, chunks, overwrite: bool = True) -> int:
    """Writes chunks to <path>.partial, syncs and renames; nothing is left on failure. Returns the bytes."""
    ensure_free(path, overwrite)
    filesystem, p = at(path)
    filesystem.create_dir(str(PurePosixPath(p).parent), recursive=True)
    partial, size = p + ".partial", 0
    try:
        with filesystem.open_output_stream(partial, compression=None) as out:
            for chunk in [chunks] if isinstance(chunks, bytes) else chunks:
                out.write(chunk)
                size += len(chunk)
        if isinstance(filesystem, fs.LocalFileSystem):
            with open(partial, "rb") as f:
                os.fsync(f.fileno())
        filesystem.move(partial, p)
    except BaseException:
        if filesystem.get_file_info(partial).type == fs.FileType.File:
            filesystem.delete_file(partial)
        raise
    return size


def write_json(path: str, value) -> None:
    write_atomic(path, (json.dumps(value, ensure_ascii=False, indent=2, default=str) + "\n").encode())


def stage_lines(df: DataFrame, column: str, order: list[str], folder: str, joiner: str = "\n") -> list[tuple[int, str, int]]:
    """Writes a text column's values in order as part files in folder: (part, name, values) of each.

    A range partitioning orders the parts, so many tasks write one file's content; names carry the task's attempt. What
    it shuffled goes with the job, not when the driver happens to collect its garbage: a copy of the data less on disk.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, p = at(folder)
        filesystem.create_dir(p, recursive=True)
        name, count = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}", 0
        with filesystem.open_output_stream(f"{p}/{name}", compression=None) as out:
            for batch in batches:
                lines = batch.column(0).to_pylist()
                if lines:
                    out.write(((joiner if count else "") + joiner.join(lines)).encode())
                    count += len(lines)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([count], pa.int64())], names=["part", "name", "n"])

    with _shuffles_dropped(df.sparkSession):
        ordered = df.select(column, *order).repartitionByRange(*order).sortWithinPartitions(*order).select(column)
        return sorted((r.part, r.name, r.n) for r in ordered.mapInArrow(write, "part int, name string, n long").collect() if r.n)


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that are built and run within remove their shuffle files as they end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@dataclass(frozen=True)
class BlockPart:
    """Lines of one input block, as written: how many, and how many weren't written (null), the first of these by its place."""

    block: int
    name: str
    n: int
    bad: int
    first_bad: int | None


def stage_blocks(df: DataFrame, folder: str, joiner: str) -> list[BlockPart]:
    """Writes (block, line) rows in the order in which tasks read them, a part file for each block, without a shuffle.

    A block is a split of an input file, whose rows reach one task in order; null lines are counted, not written.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, p = at(folder)
        filesystem.create_dir(p, recursive=True)
        kinds = {"block": pa.int64(), "name": pa.string(), "n": pa.int64(), "bad": pa.int64(), "first_bad": pa.int64()}
        out, state = None, None

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([state], schema=pa.schema(list(kinds.items())))

        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for lo, hi in itertools.pairwise(edges):
                if state is None or state["block"] != int(block[lo]):
                    if out is not None:
                        yield closed()
                    name = f"part-{int(block[lo]):016d}-{uuid.uuid4().hex[:12]}"
                    out, state = filesystem.open_output_stream(f"{p}/{name}", compression=None), {"block": int(block[lo]), "name": name, "n": 0, "bad": 0, "first_bad": None}
                lines = batch.column(1).slice(lo, hi - lo)
                if lines.null_count:
                    if state["first_bad"] is None:
                        state["first_bad"] = state["n"] + state["bad"] + pc.index(lines.is_null(), True).as_py()
                    state["bad"] += lines.null_count
                    lines = lines.drop_null()
                if len(lines):
                    text = pa.large_string()
                    joined = pc.binary_join_element_wise(pa.scalar(joiner, text), lines.cast(text), pa.scalar("", text))
                    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
                    first = int(offsets[0]) + (0 if state["n"] else len(joiner.encode()))
                    out.write(joined.buffers()[2].slice(first, int(offsets[-1]) - first))
                    state["n"] += len(lines)
        if out is not None:
            yield closed()

    done = df.select("block", "line").mapInArrow(write, "block long, name string, n long, bad long, first_bad long").collect()
    return sorted((BlockPart(r.block, r.name, r.n, r.bad, r.first_bad) for r in done), key=lambda x: (x.block, x.name))


def joined_parts(path: str, folder: str, names: list[str], head: bytes, between: bytes, tail: bytes, empty: bytes | None, overwrite: bool) -> None:
    """One file of part files in order, copied as bytes; a part goes as soon as it is copied, so there is never a second copy."""
    filesystem, p = at(folder)

    def chunks() -> Iterator[bytes]:
        if not names and empty is not None:
            yield empty
            return
        yield head
        for k, name in enumerate(names):
            if k:
                yield between
            with filesystem.open_input_stream(f"{p}/{name}", compression=None) as f:
                while block := f.read(1 << 24):
                    yield block
            filesystem.delete_file(f"{p}/{name}")
        yield tail

    write_atomic(path, chunks(), overwrite)


def drop_folder(folder: str) -> None:
    filesystem, p = at(folder)
    if filesystem.get_file_info(p).type == fs.FileType.Directory:
        filesystem.delete_dir(p)


def write_single(df: DataFrame, column: str, order: list[str], path: str, head: bytes = b"", between: bytes = b"\n", tail: bytes = b"\n", empty: bytes | None = None, overwrite: bool = True, joiner: str = "\n") -> int:
    """One file of a text column's values in order: head, the values with `between` in between, tail. Returns the values."""
    ensure_free(path, overwrite)
    folder = f"{path}.parts-{uuid.uuid4().hex[:8]}"
    try:
        parts = stage_lines(df, column, order, folder, joiner)
        joined_parts(path, folder, [name for _, name, _ in parts], head, between, tail, empty, overwrite)
        return sum(n for *_, n in parts)
    finally:
        drop_folder(folder)


def workspace(spark, name: str) -> str:
    """A fresh folder that driver and tasks share: under spark.checkpoint.dir, or a temporary one on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set; a cluster needs a folder that all its machines share")
        root = tempfile.mkdtemp(prefix="strataline-")
    path = f"{root.rstrip('/')}/strataline-files/{name}-{uuid.uuid4().hex[:12]}"
    filesystem, p = at(path)
    filesystem.create_dir(p, recursive=True)
    return path
