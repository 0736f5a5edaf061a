"""Object stores through Hadoop's file systems, chosen by the scheme of each URI."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from datetime import datetime, timezone
from itertools import batched
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icekeel.functions.paths import as_folder
from icekeel.sources.scratch import shared_dir

#: Files that are listed or deleted in a run, and what the text of a file's status tells.
RUN = 50_000
STATUS = re.compile(r"\{path=(.*?); isDirectory=(true|false);(?: length=(\d+);)?.*? modification_time=(\d+);", re.S)
LISTING = "path string, length long, modified_ms long"


class Store:
    """Whatever spark.hadoop.* reaches: s3a, gs, abfss, hdfs, viewfs, file."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm, self.conf = spark, spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, uri: str):
        path = self.jvm.org.apache.hadoop.fs.Path(uri)
        return path.getFileSystem(self.conf), path

    def exists(self, uri: str) -> bool:
        fs, path = self._at(uri)
        return fs.exists(path)

    def size(self, uri: str) -> int:
        fs, path = self._at(uri)
        return fs.getFileStatus(path).getLen()

    def modified(self, uri: str) -> datetime:
        fs, path = self._at(uri)
        return datetime.fromtimestamp(fs.getFileStatus(path).getModificationTime() / 1000, timezone.utc)

    def read(self, uri: str) -> bytes:
        fs, path = self._at(uri)
        stream = fs.open(path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, uri: str, data: bytes, overwrite: bool = True) -> None:
        """Without overwrite an existing object is a FileExistsError."""
        fs, path = self._at(uri)
        if not overwrite and fs.exists(path):
            raise FileExistsError(uri)
        try:
            stream = fs.create(path, overwrite)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(uri) from e
            raise
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> None:
        fs, path = self._at(old)
        target = self.jvm.org.apache.hadoop.fs.Path(new)
        fs.mkdirs(target.getParent())
        if not fs.rename(path, target):
            raise OSError(f"can't rename {old} to {new}")

    def delete(self, uri: str, recursive: bool = False) -> bool:
        """Whether there was something to delete."""
        fs, path = self._at(uri)
        return fs.delete(path, recursive)

    def delete_all(self, uris: Iterable[str], threads: int = 16) -> tuple[int, list[str]]:
        """(deleted, failed): goes on after an error, and counts what is really gone. uris are taken in runs, so they need not fit memory."""

        def one(uri: str) -> bool | None:
            try:
                return self.delete(uri)
            except Exception:
                return None

        deleted, failed = 0, []
        with ThreadPoolExecutor(threads) as pool:
            for run in batched(uris, RUN):
                for uri, done in zip(run, pool.map(one, run), strict=True):
                    deleted += done is True
                    failed += [uri] if done is None else []
        return deleted, failed

    def _children(self, path: str) -> tuple[list[str], list[tuple[str, int, int]]]:
        """(folders, files) of one folder, hidden ones too, in one call where statuses show as text what they hold."""
        fs, at = self._at(path)
        try:
            found = fs.listStatus(at)
        except Exception as e:
            if "FileNotFound" in str(e):
                return [], []
            raise
        n, text = len(found), self.jvm.org.apache.commons.lang3.ArrayUtils.toString(found)
        seen = STATUS.findall(text)
        if len(seen) != n or text.count("{path=") != n:
            seen = [(s.getPath().toString(), str(s.isDirectory()).lower(), str(s.getLen()), str(s.getModificationTime())) for s in found]
        return [p for p, folder, *_ in seen if folder == "true"], [(p, int(size or 0), int(ms)) for p, folder, size, ms in seen if folder != "true"]

    def rows(self, prefix: str, threads: int = 16) -> Iterator[tuple[str, int, int]]:
        """(path, length, modified ms) of all files in the folder prefix, hidden ones too; its siblings aren't in it.

        Folders are listed side by side, each by one request (a page of them for large ones).
        """
        with ThreadPoolExecutor(threads) as pool:
            running = {pool.submit(self._children, as_folder(prefix))}
            while running:
                done, running = wait(running, return_when=FIRST_COMPLETED)
                for future in done:
                    folders, files = future.result()
                    running |= {pool.submit(self._children, f) for f in folders}
                    yield from files

    def listing(self, prefix: str) -> DataFrame:
        """(path, length, modified_ms, mtime) of rows(), written in runs to a shared folder: the driver never holds all of them."""
        at = shared_dir(self.spark, "listing")
        self.spark.createDataFrame([], LISTING).write.parquet(at)
        for run in batched(self.rows(prefix), RUN):
            self.spark.createDataFrame(list(run), LISTING).coalesce(1).write.mode("append").parquet(at)
        return self.spark.read.schema(LISTING).parquet(at).withColumn("mtime", F.timestamp_millis("modified_ms"))


#: The settings of object stores by the keys of the configuration.
SETTINGS = {
    "s3": {"endpoint": "fs.s3a.endpoint", "region": "fs.s3a.endpoint.region", "access_key_id": "fs.s3a.access.key", "secret_access_key": "fs.s3a.secret.key", "path_style": "fs.s3a.path.style.access"},
    "gcs": {"project": "fs.gs.project.id", "credentials_json": "fs.gs.auth.service.account.json.keyfile"},
}
#: Schemes under which locations of a store are written, and the file system that serves them.
SCHEMES = {"s3": ("org.apache.hadoop.fs.s3a.S3AFileSystem", ("s3", "s3n")), "gcs": ("com.google.cloud.hadoop.fs.gcs.GoogleHadoopFileSystem", ("gs",))}


def hadoop_settings(storage: dict[str, Any]) -> dict[str, str]:
    """The Hadoop settings that a storage section of the configuration stands for; unset keys are left to the environment.

    Paths without a scheme lie in the container of an azure section.
    """
    kind, out = storage.get("type", ""), {}
    for key, name in SETTINGS.get(kind, {}).items():
        if storage.get(key) not in (None, ""):
            out[name] = str(storage[key]).lower() if isinstance(storage[key], bool) else str(storage[key])
    if kind in SCHEMES:
        out |= {f"fs.{scheme}.impl": SCHEMES[kind][0] for scheme in SCHEMES[kind][1]}
    if kind == "azure":
        parts = dict(p.split("=", 1) for p in (storage.get("connection_string") or "").split(";") if "=" in p)
        account, key = storage.get("account") or parts.get("AccountName"), storage.get("account_key") or parts.get("AccountKey")
        if account:
            host = f"{account}.dfs.{parts.get('EndpointSuffix', 'core.windows.net')}"
            out["fs.defaultFS"] = f"abfss://{storage['container']}@{host}/"
            if key:
                out |= {f"fs.azure.account.auth.type.{host}": "SharedKey", f"fs.azure.account.key.{host}": key}
    return out


def configure(spark: SparkSession, storage: dict[str, Any]) -> None:
    """Sets hadoop_settings() for this session's file systems, on the driver and in what it sends to executors."""
    conf = spark._jsc.hadoopConfiguration()
    for name, value in hadoop_settings(storage).items():
        conf.set(name, value)
