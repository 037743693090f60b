"""The folder that driver and executors share, files in it, and names that don't clash."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a local folder on a local master (tests), else an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexiflow-"))
    return (named or context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of a folder of its own; whoever writes there makes it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(uri: str):
    """(file system, path) of pyarrow for a path or URI as Hadoop writes it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    scheme, _, rest = uri.partition(":")
    return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }:{rest}")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each changed until no column of docs has it (in any case of letters)."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of that name, dots, blanks and quotes in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(docs: DataFrame) -> list[Column]:
    """All columns of docs, for a table that has them among others."""
    return [column(name) for name in docs.columns]


def row_hash(docs: DataFrame) -> Column:
    """A 64-bit hash of all columns of docs; it tells rows of one doc_id apart."""
    columns = [(column(f.name), f.dataType.simpleString()) for f in docs.schema.fields]
    return F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind else c for c, kind in columns])
