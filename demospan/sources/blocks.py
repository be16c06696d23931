"""Binary files of an episode each as Spark data sources: what one writes the other reads.

    target_lists   {episode}_targets.json.zip: a gzip JSON list of targets, of which some may be null
    latent_blocks  episode_{n}.bin.gz and a JSON sidecar with dtype and shape

A read has a partition for each ``FILES`` files. A filter on episodes opens the files of these episodes only; their
names follow from the numbers, so nothing is listed. A write takes rows in which those of an episode lie together
(``sinks`` sees to it) and puts each file into place whole; an episode written again replaces its file.
"""

from __future__ import annotations

import gzip
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from .. import schemas

#: files of a read's partition
FILES = 64
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]

    def __init__(self, names: Iterable[str]):
        super().__init__(None)
        self.names = tuple(names)


class EpisodeFiles(DataSource):
    """What the formats have in common; each says how it names, reads and writes an episode."""

    #: of a file's name, with the episode's number
    pattern = ""

    @staticmethod
    def file_of(episode: int) -> str:
        raise NotImplementedError

    @staticmethod
    def decode(episode: int, read) -> Iterator[tuple]:
        """Rows of an episode; ``read(ending)`` gives the bytes of its file with another ending."""
        raise NotImplementedError

    @staticmethod
    def encode(rows: list[Row]) -> dict[str, bytes]:
        """File endings and contents of an episode's rows."""
        raise NotImplementedError

    def reader(self, schema: StructType) -> DataSourceReader:
        return EpisodeReader(type(self), self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return EpisodeWriter(type(self), self.options["path"])


class EpisodeReader(DataSourceReader):
    def __init__(self, kind: type[EpisodeFiles], path: str):
        self.kind, self.path = kind, path
        self.only: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("episode",):
                self.only = wanted if self.only is None else self.only & wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, path = _place(self.path)
        if self.only is None:
            listed = files.get_file_info(fs.FileSelector(path))
        else:
            listed = files.get_file_info([f"{path}/{self.kind.file_of(e)}" for e in sorted(e for e in self.only if e is not None)])
        names = sorted(f.base_name for f in listed if f.type == fs.FileType.File and re.fullmatch(self.kind.pattern, f.base_name))
        return [Files(names[i : i + FILES]) for i in range(0, len(names), FILES)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, path = _place(self.path)
        for name in partition.names:
            episode = int(re.fullmatch(self.kind.pattern, name)[1])

            def content(ending: str | None = None) -> bytes:
                own = name if ending is None else name[: -len(self.kind.ending)] + ending
                with files.open_input_stream(f"{path}/{own}", compression=None) as f:
                    return f.read()

            yield from self.kind.decode(episode, content)


class EpisodeWriter(DataSourceWriter):
    def __init__(self, kind: type[EpisodeFiles], path: str):
        self.kind, self.path = kind, path

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        files, path = _place(self.path)
        files.create_dir(path, recursive=True)
        for episode, mine in groupby(rows, key=lambda r: r["episode"]):
            name = self.kind.file_of(episode)
            for ending, data in self.kind.encode(list(mine)).items():
                waiting = f"{path}/.{uuid4().hex}"
                with files.open_output_stream(waiting, compression=None) as f:
                    f.write(data)
                files.move(waiting, f"{path}/{name[: -len(self.kind.ending)]}{ending}")
        return WriterCommitMessage()


class TargetLists(EpisodeFiles):
    pattern, ending = r"(\d+)_targets\.json\.zip", "_targets.json.zip"

    @classmethod
    def name(cls) -> str:
        return "target_lists"

    def schema(self) -> str:
        return f"episode bigint, listed bigint, position bigint, target {schemas.TARGET}"

    @staticmethod
    def file_of(episode: int) -> str:
        return f"{episode}_targets.json.zip"

    @staticmethod
    def decode(episode: int, read) -> Iterator[tuple]:
        fields = ("type", "id", "appearance", "location")
        targets = json.loads(gzip.decompress(read()).decode("ascii"))
        for i, t in enumerate(targets or [None]):
            point = t.get("image_point") if t else None
            told = t and Row(*[*[t.get(f) for f in fields], point and [float(x) for x in point]])
            yield episode, len(targets), i, told

    @staticmethod
    def encode(rows: list[Row]) -> dict[str, bytes]:
        rows = sorted(rows, key=lambda r: r["position"])
        listed = [r["target"] and r["target"].asDict(recursive=True) for r in rows] if rows[0]["listed"] else []
        return {TargetLists.ending: gzip.compress(json.dumps(listed).encode("ascii"), mtime=0)}


class LatentBlocks(EpisodeFiles):
    pattern, ending = r"\D*(\d+)\D*\.bin\.gz", ".bin.gz"

    @classmethod
    def name(cls) -> str:
        return "latent_blocks"

    def schema(self) -> str:
        return "episode bigint, step bigint, embedding array<float>, shape array<int>"

    @staticmethod
    def file_of(episode: int) -> str:
        return f"episode_{episode}.bin.gz"

    @staticmethod
    def decode(episode: int, read) -> Iterator[pa.RecordBatch]:
        side = json.loads(read(".json"))
        block = np.frombuffer(gzip.decompress(read()), dtype=side["dtype"]).reshape(side["shape"])
        flat = np.ascontiguousarray(block.reshape(len(block), -1), dtype=np.float32)
        width = flat.shape[1] if len(flat) else 0
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * width), pa.array(flat.ravel()))
        columns = [
            pa.array([episode] * len(flat), pa.int64()), pa.array(np.arange(len(flat)), pa.int64()), vectors,
            pa.array([list(block.shape[1:])] * len(flat), pa.list_(pa.int32())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["episode", "step", "embedding", "shape"])

    @staticmethod
    def encode(rows: list[Row]) -> dict[str, bytes]:
        rows = sorted(rows, key=lambda r: r["step"])
        block = np.array([r["embedding"] for r in rows], dtype="<f4")
        side = {"dtype": "<f4", "shape": [len(rows), *(rows[0]["shape"] or block.shape[1:])]}
        return {".json": json.dumps(side).encode(), LatentBlocks.ending: gzip.compress(block.tobytes(), mtime=0)}


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session and lets filters reach them."""
    for kind in (TargetLists, LatentBlocks):
        spark.dataSource.register(kind)
    spark.conf.set(PUSHDOWN, "true")
