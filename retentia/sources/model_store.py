"""A versioned model registry on the shared storage that later sessions find.

``<root>/<key>/v<number>-<id>/`` holds one published version (whatever ``write`` puts there) and
``<root>/<key>/CURRENT`` names the one in use.  The pointer is written beside it and renamed over
it in one step, after the version is complete: a reader sees the old version or the new one,
never half of one, and a publisher that dies leaves the old one in use.  The key is a digest of
what the model was made from: the parameters and the listing of the input files (path, size,
time), so other data or other parameters are another key and nothing goes stale.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from retentia.session import shared_root


def files_digest(spark: SparkSession, paths: Sequence[str]) -> str:
    """Digest of a listing of files, independent of their order (the listing is a distributed
    scan that opens no file)."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length", "modificationTime")
    row = files.agg(F.count("*"), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    return "-".join(str(x or 0) for x in row)


def model_key(spark: SparkSession, paths: Sequence[str], params: dict) -> str:
    made_from = json.dumps([sorted(paths), files_digest(spark, paths), params], sort_keys=True)
    return hashlib.sha256(made_from.encode()).hexdigest()[:24]


class ModelStore:
    """The registry under ``root`` (default: ``models`` in the shared folder)."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.jvm, self.root = spark._jvm, (root or f"{shared_root(spark)}/retentia/models").rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.new_array = spark.sparkContext._gateway.new_array

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.conf)

    def current(self, key: str) -> str | None:
        """Folder of the version in use, or None (also when a clean-up took the version away)."""
        pointer = self._path(key, "CURRENT")
        if not self._fs().exists(pointer):
            return None
        stream = self._fs().open(pointer)
        try:
            name = bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        return f"{self.root}/{key}/{name}" if self._fs().exists(self._path(key, name)) else None

    def versions(self, key: str) -> list[str]:
        """Names of all versions written, complete or not, oldest first."""
        folder = self._path(key)
        if not self._fs().exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs().listStatus(folder)]
        return sorted(n for n in names if re.fullmatch(r"v\d{6}-[0-9a-f]{8}", n))

    def publish(self, key: str, write: Callable[[str, str], None]) -> str:
        """Write a new version with ``write(folder, version name)`` and put it in use."""
        number = max((int(v[1:7]) for v in self.versions(key)), default=0) + 1
        name = f"v{number:06d}-{uuid.uuid4().hex[:8]}"
        write(f"{self.root}/{key}/{name}", name)
        fresh = self._path(key, f".current-{name}")
        stream = self._fs().create(fresh, True)
        try:
            stream.write(bytearray(name.encode()))
        finally:
            stream.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self.conf).rename(fresh, self._path(key, "CURRENT"), how)
        return f"{self.root}/{key}/{name}"
