"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a temporary one is chosen and set, in local mode only: on
    a cluster every executor would write to a disk of its own."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tabiya-shared-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/tabiya-{label}-{uuid.uuid4().hex}"


def completed(spark: SparkSession, path: str, kind: str) -> list[str]:
    """The names of the tables `<path>/<kind>=<name>` that were written to their end."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(at(f"{path}/{kind}=*/_SUCCESS")) or []
    return sorted(f.getPath().getParent().getName().removeprefix(f"{kind}=") for f in found)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text in a small file; None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at) or files.getFileStatus(at).getLen() == 0:
        return None
    stream = files.open(at)
    try:
        return stream.readUTF()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """A small file that has its old text or the new one at any time: written beside it and renamed, which replaces."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    made, to = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(path)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.getFileSystem(conf).getUri(), conf)
    stream = made.getFileSystem(conf).create(made, True)
    try:
        stream.writeUTF(text)
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE if replace else jvm.org.apache.hadoop.fs.Options.Rename.NONE
    files.rename(made, to, options)


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream with this checkpoint, kept beside it: a new checkpoint is a new run, also in an old place."""
    path = f"{checkpoint.rstrip('/')}/_run"
    found = read_text(spark, path)
    if not found:
        found = uuid.uuid4().hex
        write_text(spark, path, found)
    return found
