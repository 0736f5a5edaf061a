"""Paths and URIs, as columns and as plain strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What column names and memory limits look like.
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
MEMORY = re.compile(r"[0-9]+(\.[0-9]+)?\s*(B|KB|MB|GB|TB)")


def dirname(path: Column | str) -> Column:
    """All before the last slash, the scheme untouched."""
    return F.regexp_replace(path, "/[^/]*$", "")


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def uri_key(uri: Column | str) -> Column:
    """What follows the bucket; paths without a scheme stay as they are."""
    return F.regexp_replace(uri, "^[^:]+://[^/]+/?", "")


def uri_bucket(uri: Column | str) -> Column:
    return F.regexp_extract(uri, "^[^:]+://([^/]+)", 1)


def key_of(uri: str) -> str:
    """uri_key() of a string; a URI without a key is an error."""
    scheme, sep, rest = uri.partition("://")
    if not sep:
        return uri
    key = rest.partition("/")[2]
    if not key:
        raise ValueError(f"no key in {uri!r}")
    return key


def bucket_of(uri: str) -> str:
    return uri.partition("://")[2].partition("/")[0]


def default_fs(spark: SparkSession) -> str:
    """What paths without a scheme lack: file: or the like."""
    return (spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///").rstrip("/")


def plain(path: Column | str, default: str) -> Column:
    """One form for the ways in which a path may be written, to compare: file:///x, file:/x and (by default) /x are one, as are s3, s3a and s3n."""
    path = F.col(path) if isinstance(path, str) else path
    rooted = F.when(F.startswith(path, F.lit("/")), F.concat(F.lit(default), path)).otherwise(path)
    return F.regexp_replace(F.regexp_replace(rooted, "^([a-z0-9]+):///+", "$1:/"), "^s3[an]://", "s3://")


def plain_path(path: str, default: str) -> str:
    """plain() of a string."""
    rooted = default + path if path.startswith("/") else path
    return re.sub("^s3[an]://", "s3://", re.sub("^([a-z0-9]+):///+", r"\1:/", rooted))


def as_folder(uri: str) -> str:
    """uri with one slash at its end, so that a sibling that shares the prefix isn't inside it."""
    return uri.rstrip("/") + "/"


def checked_identifier(name: str) -> str:
    if not IDENTIFIER.fullmatch(name):
        raise ValueError(f"not a column name: {name!r}")
    return name


def identifier_like(name: Column | str) -> Column:
    """checked_identifier() of a column: whether it is a column name."""
    return F.regexp_like(name, F.lit(f"^(?:{IDENTIFIER.pattern})$"))


def memory_bytes(limit: str) -> int:
    """The bytes of a memory limit such as 1.5 GB, in powers of 1000."""
    number, unit = re.fullmatch(r"([0-9.]+)\s*(\w+)", checked_memory(limit)).groups()
    return int(float(number) * 1000 ** ("B", "KB", "MB", "GB", "TB").index(unit))


def checked_memory(limit: str) -> str:
    if not MEMORY.fullmatch(limit):
        raise ValueError(f"not a memory limit: {limit!r}")
    return limit
