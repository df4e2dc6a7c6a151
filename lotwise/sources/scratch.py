"""The shared folder where intermediate tables are written.

The cluster names it in ``spark.checkpoint.dir``.  Only a local session may fall back to a folder
of its own; on a cluster an unset folder is an error, because a machine-local one would be lost
with its machine.
"""

import tempfile
import uuid

CONF = "spark.checkpoint.dir"
_local_fallback = {}


def scratch_root(spark):
    configured = spark.conf.get(CONF, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError(f"set {CONF} to a folder that all executors share")
    key = context.applicationId
    if key not in _local_fallback:
        _local_fallback[key] = tempfile.mkdtemp(prefix="lotwise-")
    return _local_fallback[key]


def scratch_path(spark, name):
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def commit(df, path, partition_by=()):
    """Write ``df`` and read it back: cuts the lineage and survives the loss of executors."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
