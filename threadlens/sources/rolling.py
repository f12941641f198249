"""K1 by bytes: rows through a caller's serializer into parts that are closed at a byte size.

A Python data source writer. Each task writes its own parts into a staging folder beside the target; a part is closed
as soon as it has reached ``max_bytes``, so none is over it by more than one record. Rows are held in a buffer of
``buffer_rows`` and handed over together. The driver moves the parts of the tasks that count into the target when all
have ended, and removes the staging folder; a failed job, or an attempt that does not count, leaves no part there. An
attempt that is still running when its job fails may make the staging folder once more; readers do not see it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MAX_BYTES = 13_000_000      # fixed value: the size at which a stored part is closed
BUFFER_ROWS = 40            # fixed value: rows handed over at a time


def json_line(row: Row) -> bytes:
    """The default serializer: a JSON object per line."""
    return (json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False) + "\n").encode("utf-8")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Parts(WriterCommitMessage):
    names: list[str]


class RollingWriter(DataSourceWriter):
    def __init__(self, path: str, serializer: Callable[[Row], bytes], max_bytes: int, buffer_rows: int, suffix: str):
        self.path, self.serializer, self.max_bytes, self.buffer_rows, self.suffix = (
            path.rstrip("/"), serializer, max_bytes, buffer_rows, suffix)
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Parts:
        task = TaskContext.get()
        store, folder = _store(self.staging)
        store.create_dir(folder, recursive=True)
        names: list[str] = []
        out, size, held = None, 0, []

        def flush() -> None:
            nonlocal out, size
            for record in held:
                if out is None:
                    names.append(f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(names):04d}{self.suffix}")
                    out, size = store.open_output_stream(f"{folder}/{names[-1]}"), 0
                out.write(record)
                size += len(record)
                if size >= self.max_bytes:
                    out.close()
                    out = None
            held.clear()

        for row in iterator:
            held.append(self.serializer(row))
            if len(held) >= self.buffer_rows:
                flush()
        flush()
        if out is not None:
            out.close()
        return Parts(names)

    def commit(self, messages: list[Parts | None]) -> None:
        store, folder = _store(self.path)
        _, staged = _store(self.staging)
        for message in messages:
            for name in message.names if message is not None else ():
                store.move(f"{staged}/{name}", f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Parts | None]) -> None:
        store, staged = _store(self.staging)
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)


def write_rolling(df: DataFrame, path: str, serializer: Callable[[Row], bytes] = json_line, max_bytes: int = MAX_BYTES,
                  buffer_rows: int = BUFFER_ROWS, suffix: str = ".json") -> None:
    """K1: append the rows of ``df`` to the folder ``path`` in parts of about ``max_bytes``."""
    class Rolling(DataSource):
        @classmethod
        def name(cls) -> str:
            return "threadlens_rolling"

        def writer(self, schema, overwrite: bool) -> RollingWriter:
            return RollingWriter(path, serializer, max_bytes, buffer_rows, suffix)

    df.sparkSession.dataSource.register(Rolling)
    df.write.format("threadlens_rolling").mode("append").save()
