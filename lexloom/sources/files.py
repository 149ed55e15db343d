"""Where tokenizers and training texts come from."""

from __future__ import annotations

import hashlib
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.errors import HubError
from lexloom.plans.tokenizer import Tokenizer

_NAME = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._-]{0,94}[A-Za-z0-9])?")


def lines_kept(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(text) of the lines of text files with their line ends; only the last line of a file may have none.

    Spark's reader drops line ends, so whether a file's last line had one is found
    from the file's size: a row a file, joined back."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    rows = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    sums = rows.groupBy("file").agg(F.sum(F.octet_length("value") + 1).alias("all"), F.max("size").alias("size"), F.max(F.struct("block", "at")).alias("last"))
    ends = sums.where("all > size").select("file", F.col("last.block").alias("block"), F.col("last.at").alias("at"), F.lit(True).alias("open"))
    joined = rows.join(ends, ["file", "block", "at"], "left")
    return joined.select(F.when(F.col("open"), F.col("value")).otherwise(F.concat("value", F.lit("\n"))).alias("text"))


def check_repository(name: str) -> str:
    parts = name.split("/")
    if not 1 <= len(parts) <= 2 or any(not _NAME.fullmatch(p) for p in parts) or ".." in name or "--" in name or len(name) > 96:
        raise HubError(f"bad repository name {name!r}")
    return name


def check_revision(revision: str) -> str:
    if not revision or any(p in ("", ".", "..") or "\\" in p for p in revision.split("/")) or revision.startswith("/"):
        raise HubError(f"bad revision {revision!r}")
    return revision


def cached_file(cache: str, name: str, revision: str = "main", file: str = "tokenizer.json") -> str | None:
    """The path of a file in a local hub cache whose content matches its blob's hash, or None."""
    folder = os.path.join(cache, "models--" + check_repository(name).replace("/", "--"))
    reference = os.path.join(folder, "refs", *check_revision(revision).split("/"))
    commit = revision
    if os.path.isfile(reference):
        with open(reference, encoding="ascii") as f:
            commit = f.read().strip()
    path = os.path.join(folder, "snapshots", *check_revision(commit).split("/"), file)
    if not os.path.isfile(path):
        return None
    with open(path, "rb") as f:
        data = f.read()
    blob = os.path.basename(os.path.realpath(path))
    if re.fullmatch(r"[0-9a-f]{40}", blob) and hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest() != blob:
        return None
    if re.fullmatch(r"[0-9a-f]{64}", blob) and hashlib.sha256(data).hexdigest() != blob:
        return None
    return path


def from_pretrained(name: str, revision: str = "main", cache: str | None = None) -> Tokenizer:
    """From the local cache alone; nothing is fetched."""
    cache = cache or os.environ.get("HF_HUB_CACHE") or os.path.join(os.environ.get("HF_HOME", os.path.expanduser("~/.cache/huggingface")), "hub")
    path = cached_file(cache, name, revision)
    if path is None:
        raise HubError(f"{name} at {revision} is not in the cache {cache}, and fetching is not supported")
    return Tokenizer.from_file(path)


def load(source: str, revision: str | None = None, cache: str | None = None) -> Tokenizer:
    """A file, a folder's tokenizer.json, or a repository in the cache; only the last takes a revision."""
    local = source if os.path.isfile(source) else os.path.join(source, "tokenizer.json") if os.path.isdir(source) else None
    if local is not None or source.endswith(".json") or source.count("/") > 1:
        if revision is not None:
            raise HubError("a revision needs a repository")
        return Tokenizer.from_file(local or source)
    return from_pretrained(source, revision or "main", cache)


def fingerprint(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
