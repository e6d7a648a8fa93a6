"""Little-endian ray and velocity-model files as Spark data sources.

Both are splittable.  A ray file is a number of chunks of different sizes, so an index pass reads the
twelve bytes at the head of each chunk and skips to the next; what a task reads is a range of chunks.
A model file is a header and three flat arrays, so ranges of columns are known from the header alone.
Files are opened by ``pyarrow.fs``, so paths may be local or in any store that it knows.

``spark.read.format("rayfile")`` gives a row for each chunk, ``format("velocitymodel")`` with the option
``table`` (``meta``, ``boundary`` or ``velocity``) a row for each header or node; both are written by
``df.write.format(...)`` too.  ``register`` makes the formats known to a session.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: bytes that a task reads unless the option ``split_bytes`` says otherwise, bytes of a file that is written, files indexed at a time
SPLIT_BYTES, FILE_BYTES, INDEXERS = 32 << 20, 64 << 20, 16
#: arrays of a chunk in file order, with their counts and kinds
PER_RAY, PER_POINT = {"isk": "i", "fas": "i", "ttp": "f", "etp": "f", "tca": "f", "len": "i"}, {"xry": "f", "zry": "f"}
ARRAYS = PER_RAY | PER_POINT
NAMED = {"i": "int", "f": "float"}
CHUNKS = "path string, inr int, npr int, nrr int, " + ", ".join(f"{name} array<{NAMED[kind]}>" for name, kind in ARRAYS.items())
HEADER = "nx int, nz int, nr int, x1 float, x2 float, z1 float, z2 float"
TABLES = {
    "meta": f"path string, {HEADER}",
    "boundary": "path string, ir int, ix int, z double, id int",
    "velocity": "path string, ir int, ix int, iz int, v double",
}
MODEL = f"path string, {HEADER}, zrf array<float>, idr array<int>, vel array<float>"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path.replace("file:/", "/", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def files_of(options: dict) -> list[str]:
    """The files that ``path`` (a file or folder) or ``paths`` (a JSON list) of a source's options name."""
    out = []
    for path in json.loads(options["paths"]) if "paths" in options else [options["path"]]:
        fs, inner = opened(path)
        info = fs.get_file_info(inner)
        if info.type == pafs.FileType.File:
            out.append(path)
        elif info.type == pafs.FileType.Directory:
            found = fs.get_file_info(pafs.FileSelector(inner, recursive=True))
            prefix = path.rstrip("/")
            names = (f.path[len(inner.rstrip("/")) :] for f in found if f.type == pafs.FileType.File)
            out += sorted(prefix + n for n in names if not any(part[:1] in "._" for part in n.split("/") if part))
        else:
            raise FileNotFoundError(path)
    return out


def numbers(data: bytes, at: int, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(data, f"<{kind}4", n, at)


@dataclass
class Range(InputPartition):
    """``count`` items of a file from byte ``start`` on, ``first`` of them before it, in ``size`` bytes."""

    path: str
    start: int
    count: int
    size: int
    first: int = 0
    header: tuple = ()


def chunk_bytes(npr: int, nrr: int) -> int:
    return 12 + 4 * (len(PER_RAY) * npr + len(PER_POINT) * nrr)


def chunk_ranges(path: str, split_bytes: int) -> list[Range]:
    """The index pass over one ray file: ranges of chunks of about ``split_bytes``."""
    fs, inner = opened(path)
    out: list[Range] = []
    with fs.open_input_file(inner) as f:
        at = 4
        for _ in range(int(numbers(f.read(4), 0, 1, "i")[0])):
            f.seek(at)
            _, npr, nrr = numbers(f.read(12), 0, 3, "i").tolist()
            size = chunk_bytes(npr, nrr)
            if not out or out[-1].size + size > split_bytes:
                out.append(Range(path, at, 0, 0))
            out[-1].count += 1
            out[-1].size += size
            at += size
    return out


def batch_of(schema: str, columns: list) -> pa.RecordBatch:
    """Columns as the declared types."""
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32())}
    fields = [tuple(f.split(" ")) for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


class FileSource(DataSource):
    """What both formats share: options and their defaults."""

    @property
    def split_bytes(self) -> int:
        return int(self.options.get("split_bytes", SPLIT_BYTES))


class RayFileReader(DataSourceReader):
    def __init__(self, options: dict, split_bytes: int):
        self.options, self.split_bytes = dict(options), split_bytes

    def partitions(self) -> list[Range]:
        with ThreadPoolExecutor(INDEXERS) as pool:
            return [r for ranges in pool.map(lambda path: chunk_ranges(path, self.split_bytes), files_of(self.options)) for r in ranges]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, inner = opened(partition.path)
        with fs.open_input_file(inner) as f:
            f.seek(partition.start)
            for _ in range(partition.count):
                head = f.read(12)
                inr, npr, nrr = numbers(head, 0, 3, "i").tolist()
                data, at, arrays = f.read(chunk_bytes(npr, nrr) - 12), 0, []
                for name, kind in ARRAYS.items():
                    n = npr if name in PER_RAY else nrr
                    arrays.append([numbers(data, at, n, kind)])
                    at += 4 * n
                yield batch_of(CHUNKS, [[partition.path], [inr], [npr], [nrr], *arrays])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class FolderWriter(DataSourceArrowWriter):
    """Files of a write are put into a hidden folder by the tasks, and moved by the commit."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.job = f"_write-{uuid.uuid4().hex}"

    def put(self, name: str, parts: list[bytes]) -> str:
        fs, inner = opened(self.path)
        fs.create_dir(f"{inner}/{self.job}", recursive=True)
        with fs.open_output_stream(f"{inner}/{self.job}/{name}") as f:
            for part in parts:
                f.write(part)
        return name

    def commit(self, messages: list[Written | None]) -> None:
        fs, inner = opened(self.path)
        fs.create_dir(inner, recursive=True)
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(inner)):
                if old.base_name != self.job:
                    (fs.delete_dir if old.type == pafs.FileType.Directory else fs.delete_file)(old.path)
        for message in messages:
            for name in message.files if message else []:
                fs.move(f"{inner}/{self.job}/{name}", f"{inner}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, inner = opened(self.path)
        if fs.get_file_info(f"{inner}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{inner}/{self.job}")


class RayFileWriter(FolderWriter):
    """Chunks as they come, in files of about ``FILE_BYTES``, as the number of chunks stands before them."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, chunks, held = [], [], 0

        def flush() -> None:
            if chunks:
                files.append(self.put(f"part-{uuid.uuid4().hex}.rays", [np.int32(len(chunks)).tobytes(), *chunks]))
                chunks.clear()

        for batch in iterator:
            for row in range(batch.num_rows):
                values = {name: batch.column(name)[row].values.to_numpy(zero_copy_only=False).astype(f"<{kind}4") for name, kind in ARRAYS.items()}
                npr, nrr = len(values["isk"]), len(values["xry"])
                if any(len(v) != (npr if name in PER_RAY else nrr) for name, v in values.items()):
                    raise ValueError("arrays of a chunk have different lengths")
                head = np.array([batch.column("inr")[row].as_py(), npr, nrr], "<i4")
                chunks.append(b"".join([head.tobytes(), *(v.tobytes() for v in values.values())]))
                held += len(chunks[-1])
                if held >= FILE_BYTES:
                    flush()
                    held = 0
        flush()
        return Written(files)


class RayFile(FileSource):
    @classmethod
    def name(cls) -> str:
        return "rayfile"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> RayFileReader:
        return RayFileReader(self.options, self.split_bytes)

    def writer(self, schema, overwrite: bool) -> RayFileWriter:
        return RayFileWriter(self.options["path"], overwrite)


def model_header(path: str) -> tuple:
    fs, inner = opened(path)
    with fs.open_input_file(inner) as f:
        data = f.read(28)
    return (*numbers(data, 0, 3, "i").tolist(), *numbers(data, 12, 4, "f").tolist())


class ModelReader(DataSourceReader):
    """Arrays are in the order layer, x, z; a range is one of whole columns (of ``nz`` velocities) or of
    boundary nodes."""

    def __init__(self, options: dict, table: str, split_bytes: int):
        self.options, self.table, self.split_bytes = dict(options), table, split_bytes

    def partitions(self) -> list[Range]:
        files = files_of(self.options)
        with ThreadPoolExecutor(INDEXERS) as pool:
            headers = list(pool.map(model_header, files))
        out = []
        for path, header in zip(files, headers, strict=True):
            nx, nz, nr = header[:3]
            items, size, start = {"meta": (1, 28, 0), "boundary": (nx * nr, 4, 28), "velocity": (nx * (nr + 1), 4 * nz, 28 + 8 * nx * nr)}[self.table]
            step = max(1, self.split_bytes // max(1, size))
            out += [Range(path, start + first * size, min(step, items - first), size, first, header) for first in range(0, items, step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, inner = opened(partition.path)
        nx, nz, nr = partition.header[:3]
        schema, n = TABLES[self.table], partition.count
        if self.table == "meta":
            yield batch_of(schema, [[x] for x in (partition.path, *partition.header)])
            return
        item = partition.first + np.arange(n)
        with fs.open_input_file(inner) as f:
            f.seek(partition.start)
            data = numbers(f.read(n * partition.size), 0, n * partition.size // 4, "f")
            if self.table == "boundary":
                f.seek(partition.start + 4 * nx * nr)
                ids = numbers(f.read(4 * n), 0, n, "i")
                yield batch_of(schema, [[partition.path] * n, item // nx + 1, item % nx + 1, data.astype(np.float64), ids])
                return
        across, down = np.repeat(item, nz), np.tile(np.arange(1, nz + 1), n)
        yield batch_of(schema, [[partition.path] * len(down), across // nx + 1, across % nx + 1, down, data.astype(np.float64)])


class ModelWriter(FolderWriter):
    """One file for each row of header and flat arrays, named as the row's ``path`` says."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files = []
        for batch in iterator:
            for row in range(batch.num_rows):
                value = {name: batch.column(name)[row] for name in batch.schema.names}
                nx, nz, nr = (value[c].as_py() for c in ("nx", "nz", "nr"))
                parts = [np.array([nx, nz, nr], "<i4"), np.array([value[c].as_py() for c in ("x1", "x2", "z1", "z2")], "<f4")]
                for name, kind, n in (("zrf", "f", nx * nr), ("idr", "i", nx * nr), ("vel", "f", nx * nz * (nr + 1))):
                    parts.append(value[name].values.to_numpy(zero_copy_only=False).astype(f"<{kind}4"))
                    if len(parts[-1]) != n:
                        raise ValueError(f"{name} has {len(parts[-1])} numbers in place of {n}")
                files.append(self.put(value["path"].as_py().rstrip("/").split("/")[-1], [p.tobytes() for p in parts]))
        return Written(files)


class VelocityModel(FileSource):
    @classmethod
    def name(cls) -> str:
        return "velocitymodel"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "velocity")]

    def reader(self, schema) -> ModelReader:
        return ModelReader(self.options, self.options.get("table", "velocity"), self.split_bytes)

    def writer(self, schema, overwrite: bool) -> ModelWriter:
        return ModelWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    for source in (RayFile, VelocityModel):
        spark.dataSource.register(source)


def _loaded(spark: SparkSession, kind: str, paths: str | list[str], split_bytes: int, **options: str) -> DataFrame:
    register(spark)
    listed = json.dumps([paths] if isinstance(paths, str) else list(paths))
    return spark.read.format(kind).options(paths=listed, split_bytes=str(split_bytes), **options).load()


def read_rayfiles(spark: SparkSession, paths: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per chunk (instrument) of every file; several files are simply read together."""
    return _loaded(spark, "rayfile", paths, split_bytes)


def write_rayfiles(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """``chunks`` has ``inr`` and the arrays of a chunk; each task writes files of its own."""
    register(chunks.sparkSession)
    rows = chunks.select(F.col("inr").cast("int").alias("inr"), *[F.col(name).cast(f"array<{NAMED[kind]}>").alias(name) for name, kind in ARRAYS.items()])
    rows.write.format("rayfile").mode(mode).save(path)


def read_velocity_model(spark: SparkSession, paths: str | list[str], split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``meta``, ``boundary(ir, ix, z, id)`` and ``velocity(ir, ix, iz, v)`` with the ``path`` of each file;
    numbers start at 1."""
    return tuple(_loaded(spark, "velocitymodel", paths, split_bytes, table=t) for t in TABLES)


def write_velocity_model(meta: DataFrame, boundary: DataFrame, velocity: DataFrame, path: str, mode: str = "append") -> None:
    """A file for each row of ``meta``, whose ``path`` names it; the tables are those that are read.

    A file is one model, so its arrays meet in the task that writes it.
    """
    register(meta.sparkSession)
    flat = lambda df, *by: df.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(*by))).alias("all"))
    nodes = flat(boundary, "ir", "ix", "z", "id").select("path", F.col("all.z").alias("zrf"), F.col("all.id").alias("idr"))
    cells = flat(velocity, "ir", "ix", "iz", "v").select("path", F.col("all.v").alias("vel"))
    rows = meta.join(nodes, "path").join(cells, "path")
    rows = rows.select(*[F.col(f.split(" ")[0]).cast(f.split(" ")[1]) for f in MODEL.split(", ")])
    rows.write.format("velocitymodel").mode(mode).save(path)
