"""Tables that several parts of a plan read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that plans that read it several times do not compute
    it again and a lost executor costs nothing. The folder is the session's; in local mode one is made if there is none."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="larkspan-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
