"""Files that driver and executors share: folders below spark.checkpoint.dir, and access by URI from tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; only a local session may lack the setting, and gets a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store_of(uri: str):
    """(file system, path) of a URI or an absolute path."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def data_files(uri: str, endings: tuple[str, ...]) -> list[str]:
    """URIs of a file, or of the files of a folder with one of the endings, by name; names that begin with . or _ are hidden."""
    from pyarrow import fs

    store, path = store_of(uri)
    root = uri[: len(uri) - len(path)] if uri.endswith(path) else "file://"
    if store.get_file_info(path).type == fs.FileType.File:
        return [root + path]
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(root + f.path for f in found if f.is_file and f.base_name[0] not in "._" and f.base_name.lower().endswith(endings))
