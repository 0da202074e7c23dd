"""Sessions and the one place where a plan's lineage is cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, checkpoints: str | None = None, **conf: str) -> SparkSession:
    """A session for tests, bench.py and the commands; a cluster brings its own. `checkpoints` is the folder for what
    `cut` writes; a session that runs on several machines needs one that all of them share."""
    builder = SparkSession.builder.master(master).appName("codestrata")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.adaptive.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | ({"spark.checkpoint.dir": checkpoints} if checkpoints else {}) | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder and read back: later plans start there and survive lost executors.

    The folder is the one that the cluster names in spark.checkpoint.dir. Only a local session without that setting
    gets a folder of its own; anywhere else a missing setting is an error, since a machine-local folder would be lost
    with its machine.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), "codestrata-checkpoints")
        context.setCheckpointDir(folder)
    # A checkpoint keeps the size that was estimated for its plan. A loop of joins multiplies these estimates, and soon
    # planning only multiplies numbers of a million digits; so the written rows come back as a source of unknown size.
    written = df.checkpoint(eager=True)._jdf
    session = df.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(written.queryExecution().toRdd(), written.schema(), False), session)
