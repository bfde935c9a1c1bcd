"""A sink of text files by name, which are all there when the write is done, or none is."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """A task's folder of drafts, and the names that they are to get."""

    folder: str
    names: list[str]


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, folder: str) -> None:
        self.folder, self.run = folder.rstrip("/"), uuid.uuid4().hex

    def _at(self) -> tuple[FileSystem, str, str]:
        fs, root = FileSystem.from_uri(self.folder)
        return fs, root, f"{root}/.drafts-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Neighbouring rows of one name become one draft; a repeated task has a folder of its own."""
        fs, _, drafts = self._at()
        context = TaskContext.get()
        own, names, out = f"{drafts}/{context.partitionId()}-{context.taskAttemptId()}", [], None
        try:
            for b in iterator:
                for name, text in zip(b.column("name").to_pylist(), b.column("text").to_pylist(), strict=True):
                    if not names or names[-1] != name:
                        if out:
                            out.close()
                        fs.create_dir(own, recursive=True)
                        out = fs.open_output_stream(f"{own}/{len(names)}")
                        names.append(name)
                    out.write((text or "").encode())
        finally:
            if out:
                out.close()
        return Written(own, names)

    def commit(self, messages: list[Written | None]) -> None:
        """Moves the drafts of the tasks that count; a file that is there already is replaced."""
        fs, root, drafts = self._at()
        moves = [(f"{m.folder}/{i}", f"{root}/{name}") for m in messages if m is not None for i, name in enumerate(m.names)]
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: fs.move(*x), moves))
        self._drop(fs, drafts)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _, drafts = self._at()
        self._drop(fs, drafts)

    @staticmethod
    def _drop(fs: FileSystem, drafts: str) -> None:
        try:
            fs.delete_dir(drafts)
        except FileNotFoundError:  # no task had a row
            pass


class Documents(DataSource):
    """Format ``documents``: rows of name and text as files in the option ``folder``, on any file system that pyarrow knows (file, hdfs, s3, gs)."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:  # noqa: ANN001
        return DocumentWriter(self.options["folder"])


def write_documents(rows: DataFrame, folder: str) -> None:
    """``rows`` have name and text, and place if a file has several rows; those of a file go through one task, a batch at a time."""
    rows.sparkSession.dataSource.register(Documents)
    if "place" in rows.columns:
        rows = rows.repartition("name").sortWithinPartitions("name", "place")
    rows.select("name", "text").write.format("documents").mode("append").option("folder", folder).save()
