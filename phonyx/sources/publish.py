"""A sink that publishes a run as a whole: tasks stage their files, the commit checks them and switches one pointer, and a failure leaves the run before in place.

Layout under the path: `runs/<id>/predictions_<subset>.<part>.jsonl`, its
`manifest.json` (for each file its subset, rows and sha256) and `CURRENT`, the
id of the published run. Files of task attempts that did not commit are not in
the manifest and go before the switch. The folder must be one that pyarrow can
write to and whose files can be renamed.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

POINTER, MANIFEST = "CURRENT", "manifest.json"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def read_text(fs: pafs.FileSystem, path: str) -> str | None:
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(path) as f:
        return f.read().decode()


def put_text(fs: pafs.FileSystem, path: str, text: str) -> None:
    """Written beside its place first, then moved there."""
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(text.encode())
    fs.move(own, path)


@dataclass
class Staged(WriterCommitMessage):
    #: (file, subset, rows, sha256)
    files: list[tuple[str, str, int, str]] = field(default_factory=list)


class RunWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.path, self.subset, self.overwrite = options["path"].rstrip("/"), options.get("subset", "subset"), overwrite
        self.run = uuid.uuid4().hex
        if self.subset not in schema.names:
            raise ValueError(f"no column {self.subset!r} to name the files by")

    def write(self, iterator: Iterator[Row]) -> Staged:
        fs, root = opened(self.path)
        folder, part = f"{root}/runs/{self.run}", uuid.uuid4().hex
        fs.create_dir(folder, recursive=True)
        out: dict = {}
        for row in iterator:
            subset = str(row[self.subset])
            if not re.fullmatch(r"[\w.-]+", subset):
                raise ValueError(f"not a name of a subset: {subset!r}")
            if subset not in out:
                name = f"predictions_{subset}.{part}.jsonl"
                out[subset] = [name, fs.open_output_stream(f"{folder}/{name}"), hashlib.sha256(), 0]
            line = json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str).encode() + b"\n"
            out[subset][1].write(line)
            out[subset][2].update(line)
            out[subset][3] += 1
        for _, stream, _, _ in out.values():
            stream.close()
        return Staged([(name, subset, rows, digest.hexdigest()) for subset, (name, _, digest, rows) in out.items()])

    def commit(self, messages: list[Staged | None]) -> None:
        """Checks what is staged, then switches the pointer. Subsets of the run before stay, and one that it has already is a conflict unless the mode is overwrite."""
        fs, root = opened(self.path)
        folder = f"{root}/runs/{self.run}"
        fs.create_dir(folder, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        for name, _, _, digest in files:
            with fs.open_input_stream(f"{folder}/{name}") as f:
                if hashlib.sha256(f.read()).hexdigest() != digest:
                    raise ValueError(f"staged file changed: {name}")
        before = manifest(self.path)
        both = sorted({s for _, s, _, _ in files} & {f["subset"] for f in before})
        if both and not self.overwrite:
            raise ValueError(f"already published: {', '.join(both)}")
        kept = [f for f in before if f["subset"] not in both]
        known = {name for name, *_ in files}
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            if info.base_name not in known:
                fs.delete_file(info.path)  # of an attempt that did not commit
        rows = [{"file": f"runs/{self.run}/{name}", "subset": s, "rows": n, "sha256": d} for name, s, n, d in files]
        put_text(fs, f"{folder}/{MANIFEST}", json.dumps(sorted(kept + rows, key=lambda f: (f["subset"], f["file"])), indent=1))
        put_text(fs, f"{root}/{POINTER}", self.run)

    def abort(self, messages: list[Staged | None]) -> None:
        fs, root = opened(self.path)
        folder = f"{root}/runs/{self.run}"
        if fs.get_file_info(folder).type == pafs.FileType.Directory and read_text(fs, f"{root}/{POINTER}") != self.run:
            fs.delete_dir(folder)


class PublishedRun(DataSource):
    """`df.write.format("published_run").option("subset", column).mode("append" or "overwrite").save(path)`."""

    @classmethod
    def name(cls) -> str:
        return "published_run"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return RunWriter(self.options, schema, overwrite)


def manifest(path: str) -> list[dict]:
    """The published files; none where nothing is published."""
    fs, root = opened(path)
    run = read_text(fs, f"{root}/{POINTER}")
    return [] if run is None else json.loads(read_text(fs, f"{root}/runs/{run}/{MANIFEST}") or "[]")


def publish(df: DataFrame, path: str, subset: str = "subset", overwrite: bool = False) -> None:
    df.sparkSession.dataSource.register(PublishedRun)
    df.write.format("published_run").option("subset", subset).mode("overwrite" if overwrite else "append").save(path)


def published(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the published run."""
    files = manifest(path)
    return spark.read.schema(schema).json([f"{path.rstrip('/')}/{f['file']}" for f in files]) if files else spark.createDataFrame([], schema)
