"""Session settings and the shared scratch folder."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Nothing here sizes the cluster: partition counts come from the data through
# adaptive execution, and a deployment sets its own memory and core numbers.
ENGINE_CONF = {
    # Event times are UTC in every document.
    "spark.sql.session.timeZone": "UTC",
    # Re-plans joins on measured sizes, splits hot partitions, merges tiny ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Writes replace only the partitions they carry.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Of a key that a JSON object names twice, the last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Ask for every join key when co-partitioning; see operators.keyed.
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the engine's results rely on."""
    for name, value in ENGINE_CONF.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession, label: str) -> str:
    """Return a fresh path below the folder the cluster shares.

    ``spark.checkpoint.dir`` names that folder. Where it is unset, only a local
    session may fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder every executor can reach"
            )
        root = tempfile.mkdtemp(prefix="wardbook-")
    return posixpath.join(root, f"{label}-{uuid.uuid4().hex}")


class Folder:
    """A path in whatever store it names, for the few things that are done to names alone."""

    def __init__(self, spark: SparkSession, path: str):
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._as_text = spark._jvm.org.apache.commons.lang3.ArrayUtils.toString
        self._path = self._hadoop.Path(path)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._store = self._path.getFileSystem(conf)

    def exists(self) -> bool:
        return self._store.exists(self._path)

    def children(self) -> list[str]:
        """Full names of what lies in the folder; none if it is missing."""
        if not self.exists():
            return []
        return [str(s.getPath().toString()) for s in self._store.listStatus(self._path)]

    def empty_files(self, ending: str) -> list[str]:
        """Names of the files without a byte, which no scan and no listing of Spark shows.

        One call brings the whole listing over as text.
        """
        if not self.exists():
            return []
        listed = self._as_text(self._store.listStatus(self._path))
        found = re.findall(r"path=([^;]*/[^;]*); isDirectory=false; length=0;", listed)
        names = [posixpath.basename(path) for path in found]
        return [n for n in names if n.endswith(ending) and n[0] not in "._"]

    def partitions(self, above: str = "") -> list[str]:
        """Relative names of the deepest folders named ``column=value``."""
        found = []
        for status in self._store.listStatus(self._path):
            name = status.getPath().getName()
            if status.isDirectory() and "=" in name:
                step = posixpath.join(above, name)
                inner = Folder.__new__(Folder)
                inner.__dict__.update(self.__dict__, _path=status.getPath())
                found += inner.partitions(step) or [step]
        return found

    def move_to(self, path: str) -> None:
        target = self._hadoop.Path(path)
        self._store.mkdirs(target.getParent())
        if not self._store.rename(self._path, target):
            raise OSError(f"cannot move {self._path.toString()} to {path}")

    def delete(self) -> None:
        self._store.delete(self._path, True)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``shared_folder`` named, once nothing reads it any more."""
    Folder(spark, path).delete()
