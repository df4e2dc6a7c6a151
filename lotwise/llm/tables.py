"""Written intermediate tables: they cut lineage and survive lost executors.

The cluster names the shared folder in ``spark.checkpoint.dir``; only a session on one machine
without that setting gets a folder of its own.
"""

import tempfile
import uuid

CONF = "spark.checkpoint.dir"
_own = {}


def shared_folder(spark):
    folder = spark.conf.get(CONF, None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError(f"set {CONF} to a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="llm-tables-")
    return _own[context.applicationId]


def commit(df, name):
    """Write ``df`` below the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(names, start):
    """``start``, or longer, so that no given column has this name in either case."""
    taken = {n.lower() for n in names}
    while start.lower() in taken:
        start += "_"
    return start
