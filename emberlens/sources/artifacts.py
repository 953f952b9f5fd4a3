"""Stored analyses that are replaced as a whole: data under a new name, a manifest renamed into place last.

``<folder>/<analysis>/data-*`` hold tables, ``manifest-*.json`` name one each, numbered. Readers go by the
manifest with the largest number alone, so a write that fails or is killed anywhere leaves the artifact before
it as it was; what no manifest names is deleted by ``vacuum``. A manifest is never overwritten: of two
writers that want one number the second takes the next. Folders may be in any store that Spark writes.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,199}")
ATTEMPTS = 100


def _place(folder: str, analysis: str) -> str:
    if not NAME.fullmatch(analysis):
        raise ValueError(f"no name for an analysis: {analysis!r}")
    return f"{folder.rstrip('/')}/{analysis}"


class _Store:
    """The few things that Spark's own file systems do for us."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> bytes:
        f = self.fs.open(self.path(name))
        try:
            return bytes(f.readAllBytes())
        finally:
            f.close()

    def write(self, name: str, data: bytes) -> None:
        f = self.fs.create(self.path(name), False)
        try:
            f.write(data)
        finally:
            f.close()

    def rename(self, a: str, b: str) -> bool:
        return not self.fs.exists(self.path(b)) and bool(self.fs.rename(self.path(a), self.path(b)))

    def delete(self, name: str) -> bool:
        return bool(self.fs.delete(self.path(name), True))


def _manifests(store: _Store, place: str) -> list[int]:
    return sorted(int(m[1]) for n in store.names(place) if (m := re.fullmatch(r"manifest-(\d{10})\.json", n)))


def _manifest(place: str, version: int) -> str:
    return f"{place}/manifest-{version:010d}.json"


def write_artifact(df: DataFrame, folder: str, analysis: str, **about: Any) -> int:
    """df as the new version of an analysis; its number. about: what the manifest says beside the data."""
    place = _place(folder, analysis)
    store = _Store(df.sparkSession, folder)
    data = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{place}/{data}")
    draft = f"{place}/draft-{uuid.uuid4().hex}"
    for _ in range(ATTEMPTS):
        version = max(_manifests(store, place), default=0) + 1
        store.write(draft, json.dumps({"about": about, "data": data, "version": version}, sort_keys=True).encode())
        if store.rename(draft, _manifest(place, version)):
            return version
        store.delete(draft)
    raise RuntimeError(f"others keep on writing {analysis}")


def describe_artifact(spark: SparkSession, folder: str, analysis: str, version: int | None = None) -> dict[str, Any] | None:
    """The manifest of the newest version or of one, None if there is none."""
    place, store = _place(folder, analysis), _Store(spark, folder)
    known = _manifests(store, place)
    version = max(known, default=None) if version is None else version
    return json.loads(store.read(_manifest(place, version))) if version in known else None


def read_artifact(spark: SparkSession, folder: str, analysis: str, version: int | None = None) -> DataFrame:
    """The newest version of an analysis, or one that hasn't been deleted."""
    m = describe_artifact(spark, folder, analysis, version)
    if m is None:
        raise FileNotFoundError(f"no artifact {analysis}" + ("" if version is None else f" of version {version}"))
    return spark.read.parquet(f"{_place(folder, analysis)}/{m['data']}")


def list_artifacts(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Analyses with their newest version."""
    store = _Store(spark, folder)
    found = [(n, max(_manifests(store, f"{folder.rstrip('/')}/{n}"), default=0)) for n in store.names(folder) if NAME.fullmatch(n)]
    return [(n, v) for n, v in found if v]


def delete_artifact(spark: SparkSession, folder: str, analysis: str) -> bool:
    """Whether there was one. Manifests go first, newest last, so that no reader finds half of it."""
    place, store = _place(folder, analysis), _Store(spark, folder)
    known = _manifests(store, place)
    for v in known:
        store.delete(_manifest(place, v))
    return store.delete(place) and bool(known)


def vacuum(spark: SparkSession, folder: str, analysis: str, keep: int = 1) -> list[str]:
    """Deletes all but the newest ``keep`` versions and what no manifest names; the names deleted. Writers must be
    done: data without a manifest may be of one that is at work."""
    if keep < 1:
        raise ValueError("the newest version stays")
    place, store = _place(folder, analysis), _Store(spark, folder)
    known = _manifests(store, place)
    gone = [f"manifest-{v:010d}.json" for v in known[:-keep]]
    used = {json.loads(store.read(_manifest(place, v)))["data"] for v in known[-keep:]}
    gone += [n for n in store.names(place) if n.startswith(("data-", "draft-")) and n not in used]
    for n in gone:
        store.delete(f"{place}/{n}")
    return gone
