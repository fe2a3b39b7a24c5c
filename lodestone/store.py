"""Where indexes and project lists are kept, and the small JSON files there.

The folder is ``spark.lodestone.store`` if the session sets it, else ``lodestone`` in the warehouse, which driver and
executors share.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

CONF = "spark.lodestone.store"


def default(spark: SparkSession) -> str:
    named = spark.conf.get(CONF, None)
    folder = named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lodestone"
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return folder.rstrip("/")


def of_project(folder: str, root: str) -> str:
    """A project's own folder, by a hash of its place."""
    place = root if "://" in root else os.path.abspath(root)
    return f"{folder}/{hashlib.sha256(place.encode()).hexdigest()[:12]}"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_json(path: str):
    """None where there is no such file; ValueError where it holds no JSON."""
    store, at = opened(path)
    if store.get_file_info(at).type != fs.FileType.File:
        return None
    with store.open_input_stream(at) as f:
        return json.loads(f.read())


def write_json(path: str, value) -> None:
    """Written beside and moved there, so that a reader finds the old file or the new one."""
    store, at = opened(path)
    base = at.rsplit("/", 1)[0]
    store.create_dir(base, recursive=True)
    fresh = f"{base}/.{uuid.uuid4().hex}"
    with store.open_output_stream(fresh) as f:
        f.write(json.dumps(value).encode())
    store.move(fresh, at)
