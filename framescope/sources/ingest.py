"""Convert an input to Parquet once, and on request again when it has changed."""

from __future__ import annotations

import json
import logging
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .readers import CORRUPT, as_frame, split_malformed

log = logging.getLogger(__name__)

# Beside the data, under a name that readers of the folder skip.
MANIFEST = "_source.json"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def is_complete(spark: SparkSession, folder: str) -> bool:
    """Whether a write to the folder has ended, on any file system that Spark knows."""
    mark, files = _path(spark, folder.rstrip("/") + "/_SUCCESS")
    return files.exists(mark)


def manifest_of(spark: SparkSession, source: str) -> list[list]:
    """Name, size and time of every file of the source, in order; one line of it per file."""
    path, files = _path(spark, source)
    found = []
    for root in files.globStatus(path) or []:
        listed = files.listFiles(root.getPath(), True)
        while listed.hasNext():
            one = listed.next()
            name = one.getPath().toString()
            if not any(part[:1] in ("_", ".") for part in name.rsplit("/", 1)[-1:]):
                found.append([name, one.getLen(), one.getModificationTime()])
    return sorted(found)


def kept_manifest(spark: SparkSession, target: str) -> list[list] | None:
    """The manifest that was written with the target, if any."""
    path, files = _path(spark, f"{target.rstrip('/')}/{MANIFEST}")
    if not files.exists(path):
        return None
    stream = files.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def put_manifest(spark: SparkSession, folder: str, manifest: list[list]) -> None:
    path, files = _path(spark, f"{folder}/{MANIFEST}")
    stream = files.create(path, True)
    try:
        stream.write(bytearray(json.dumps(manifest).encode()))
    finally:
        stream.close()


def swap(spark: SparkSession, staged: str, target: str) -> None:
    """Put the staged folder in the target's place; what was there goes once the new one stands."""
    new, files = _path(spark, staged)
    place, _ = _path(spark, target)
    old, _ = _path(spark, f"{target}.old-{uuid.uuid4().hex}")
    if place.getParent() is not None:
        files.mkdirs(place.getParent())
    had = files.exists(place)
    if had and not files.rename(place, old):
        raise OSError(f"cannot move {target} away")
    if not files.rename(new, place):
        if had:
            files.rename(old, place)
        raise OSError(f"cannot move {staged} to {target}")
    if had:
        files.delete(old, True)


def ingest(
    spark: SparkSession,
    source: str,
    target: str,
    schema: T.StructType | str | None = None,
    infer: bool = False,
    quarantine: str | None = None,
    refresh: bool = False,
) -> DataFrame | None:
    """Write ``source`` as Parquet to ``target`` unless that is complete, and return the target.

    The new table is written beside the target, with a list of the source's files, sizes and
    times, and takes its place when it is whole: a reader meanwhile sees the old table. A target
    without the writer's mark of success, as a broken run leaves it, is written again, and with
    ``refresh`` also one that was made from other files, sizes or times. An input that is not there is reported and gives ``None``. With
    ``quarantine`` the malformed rows of a CSV with a schema go to that folder, as text.
    """
    try:
        frame = as_frame(spark, source, schema, infer, corrupt=CORRUPT if quarantine else None)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("nothing to ingest at %s", source)
        return None
    target = target.rstrip("/")
    manifest = manifest_of(spark, source)
    if not is_complete(spark, target) or (refresh and kept_manifest(spark, target) != manifest):
        staged = f"{target}.staging-{uuid.uuid4().hex}"
        if quarantine:
            # One pass over the source; both parts are read from what it wrote.
            whole = f"{staged}-whole"
            frame.write.parquet(whole)
            rows, malformed = split_malformed(spark.read.schema(frame.schema).parquet(whole))
            malformed.write.mode("overwrite").parquet(quarantine)
            rows.write.parquet(staged)
            path, files = _path(spark, whole)
            files.delete(path, True)
        else:
            frame.write.parquet(staged)
        put_manifest(spark, staged, manifest)
        swap(spark, staged, target)
    return spark.read.parquet(target)
