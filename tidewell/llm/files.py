"""Binary files that tasks write to the cluster's shared store and read from it."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

from ..session import scratch_dir


def folder(spark: SparkSession, label: str) -> str:
    """A fresh shared folder as a URI that pyarrow's file systems understand (file, hdfs, s3, gs)."""
    return scratch_dir(spark, label)


class Output:
    """A file that grows by parts. Its name is new for each attempt: a repeated task leaves an unused file, never a mixed one."""

    def __init__(self, base: str, suffix: str):
        from pyarrow import fs

        self.uri = f"{base}/{uuid.uuid4().hex}{suffix}"
        system, path = fs.FileSystem.from_uri(self.uri)
        system.create_dir(os.path.dirname(path), recursive=True)
        self.stream, self.size = system.open_output_stream(path, compression=None), 0

    def write(self, data: bytes) -> int:
        """Append; returns the offset at which the data lies."""
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.stream.close()


def open_input(uri: str):
    """A seekable file for reading."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
