"""Versions of a published layer: written aside, made visible by one rename, the newest few kept."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from tablesense import values as V

#: Under a layer's root: data folders of any name, and one small file for each version that names its folder.
DATA, MANIFESTS = "data", "manifests"


def _files(spark: SparkSession, root: str):
    """Hadoop's file system of a folder, and how it spells a path."""
    spell = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return spell(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spell


def _names(fs, path) -> dict[str, int]:
    """name -> time of its last change in seconds, of what lies in a folder."""
    return {s.getPath().getName(): s.getModificationTime() // 1000 for s in fs.listStatus(path)} if fs.exists(path) else {}


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions that can be read, oldest first.  A write that was interrupted is none of them."""
    fs, spell = _files(spark, root)
    return sorted(int(name) for name in _names(fs, spell(f"{root}/{MANIFESTS}")) if name.isdigit())


def stage(layer: DataFrame, root: str) -> str:
    """Write a layer aside, under a name of its own that no version has yet; the name."""
    folder = uuid.uuid4().hex
    layer.write.parquet(f"{root}/{DATA}/{folder}")
    return folder


def publish_version(layer: DataFrame, root: str, keep: int = V.LAYER_VERSIONS, torn_after: int = 86_400) -> int:
    """Write the next version of a layer and return its number.

    The rows are written aside first and the version exists from the moment its manifest is renamed into place, so a
    reader sees a whole version or none, and a job that dies in between leaves the versions as they were.  If
    another writer took the number, the next one is tried; file systems that let a rename replace a file (a local
    one) want one writer at a time.  Then all but the newest ``keep`` versions go, and with them what interrupted writes
    left behind more than ``torn_after`` seconds ago.
    """
    spark = layer.sparkSession
    fs, spell = _files(spark, root)
    folder = stage(layer, root)
    fs.mkdirs(spell(f"{root}/{MANIFESTS}"))
    aside = spell(f"{root}/{MANIFESTS}/_{folder}")
    out = fs.create(aside, False)
    out.write(bytearray(folder.encode()))
    out.close()
    version = max(versions(spark, root), default=0) + 1
    while fs.exists(spell(f"{root}/{MANIFESTS}/{version}")) or not fs.rename(aside, spell(f"{root}/{MANIFESTS}/{version}")):
        if not fs.exists(aside):
            raise FileNotFoundError(f"the manifest of version {version} is gone from {root}")
        version += 1
    drop_versions(spark, root, keep, torn_after)
    return version


def _folder(spark: SparkSession, root: str, version: int) -> str:
    fs, spell = _files(spark, root)
    path = spell(f"{root}/{MANIFESTS}/{version}")
    if not fs.exists(path):
        raise ValueError(f"{root} has no version {version}")
    source = fs.open(path)
    try:
        return "".join(chr(source.read()) for _ in range(32))  # a folder's name is 32 digits long
    finally:
        source.close()


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version of a layer, the newest if none is named."""
    if version is None:
        known = versions(spark, root)
        if not known:
            raise ValueError(f"{root} has no version yet")
        version = known[-1]
    return spark.read.parquet(f"{root}/{DATA}/{_folder(spark, root, version)}")


def drop_versions(spark: SparkSession, root: str, keep: int = V.LAYER_VERSIONS, torn_after: int = 86_400) -> list[int]:
    """Delete all but the newest ``keep`` versions, manifest before data, and old folders that no version names; the versions dropped."""
    fs, spell = _files(spark, root)
    known = versions(spark, root)
    gone = known[:max(0, len(known) - max(1, keep))]
    for version in gone:
        folder = _folder(spark, root, version)
        fs.delete(spell(f"{root}/{MANIFESTS}/{version}"), False)
        fs.delete(spell(f"{root}/{DATA}/{folder}"), True)
    named = {_folder(spark, root, version) for version in known if version not in gone}
    oldest = time.time() - torn_after
    for name, at in _names(fs, spell(f"{root}/{DATA}")).items():
        if name not in named and at < oldest:
            fs.delete(spell(f"{root}/{DATA}/{name}"), True)
            fs.delete(spell(f"{root}/{MANIFESTS}/_{name}"), False)
    return gone
