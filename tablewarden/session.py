"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def session(app: str = "tablewarden", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the package is tuned for.

    On a cluster ``master`` stays unset and the deployment supplies memory, cores
    and ``spark.checkpoint.dir``; only settings that do not depend on the size of
    the cluster are fixed here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A fresh path, not made yet, in the shared folder the cluster names; it goes when the application ends.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, the folder lies below
    ``spark.sql.warehouse.dir``, which all executors reach as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base.rstrip('/')}/tablewarden-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{folder}/data"
