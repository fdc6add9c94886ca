"""Files of formats that Spark does not write: each task writes under a temporary folder, and the driver moves all at once when all tasks have done well.

The target is a folder that the driver and all executors see by the same local path, such as a network mount: Python tasks can't write by Spark's own
file systems. A task that is tried again writes anew; what failed or lost tasks have left goes with the temporary folder.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    """Where a task has put its files, by their final names."""

    files: dict[str, str]


class TwoPhaseWriter(DataSourceWriter):
    """write_files(rows, folder), to be given by the format, writes a task's rows into a folder of its own."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        if "path" not in options:
            raise ValueError("no path to write to")
        self.path, self.options, self.schema, self.overwrite = options["path"].removeprefix("file://").rstrip("/"), dict(options), schema, overwrite
        self.temporary = f"{self.path}/_temporary-{uuid.uuid4().hex}"
        os.makedirs(self.path, exist_ok=True)

    def write_files(self, rows: Iterator[Row], folder: str) -> None:
        raise NotImplementedError

    def write(self, rows: Iterator[Row]) -> Written:
        folder = f"{self.temporary}/{uuid.uuid4().hex}"  # another one for each try
        os.makedirs(folder)
        self.write_files(rows, folder)
        return Written({name: f"{folder}/{name}" for name in os.listdir(folder)})

    def commit(self, messages: list[Written | None]) -> None:
        told = [item for m in messages if m for item in m.files.items()]
        if len({name for name, _ in told}) < len(told):
            self.abort(messages)
            raise ValueError("two tasks wrote a file of the same name")
        if self.overwrite:
            for name in os.listdir(self.path):
                if not name.startswith("_temporary-"):
                    os.remove(f"{self.path}/{name}")
        for name, place in told:
            os.replace(place, f"{self.path}/{name}")
        shutil.rmtree(self.temporary, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.temporary, ignore_errors=True)


def sink(name_: str, writer_: type[TwoPhaseWriter]) -> type[DataSource]:
    """A data source of that name that can be written only."""

    class Sink(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return writer_(self.options, schema, overwrite)

    return Sink
