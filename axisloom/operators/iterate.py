"""Driver loops over DataFrame plans, with lineage cut through the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share: the session's; a temporary one only where all runs on one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="axisloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: it outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for loops that join their state.

    A checkpoint keeps the plan's size estimate, and that of a join is the product of its sides': over rounds of joins
    the estimate alone outgrows memory. A table has the size that it has.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/axisloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Remove the files of tables made by :func:`written` that nothing reads again."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for f in df.inputFiles()[:1]:
            path = sc._jvm.org.apache.hadoop.fs.Path(f).getParent()
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame, DataFrame], float] | None = None, tolerance: float = 0.0, most: int = 100, every: int = 5) -> tuple[DataFrame, int]:
    """Repeat ``step`` until ``change(old, new)`` is at most ``tolerance``; tested and saved every few steps.

    Without ``change`` there are ``most`` steps; with it, not settling in ``most`` is an error.
    """
    done, kept = 0, state
    while done < most:
        for _ in range(min(every, most - done)):
            state = step(state)
            done += 1
        state = saved(state)
        if change is not None and change(kept, state) <= tolerance:
            return state, done
        kept = state
    if change is not None:
        raise RuntimeError(f"the state did not settle in {most} steps")
    return state, done
