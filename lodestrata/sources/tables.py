"""Reading the engine's tables and cutting lineage safely on a cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one parquet table, with only the named columns when any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows over all cores before a CPU-heavy Python stage.

    Nothing is shuffled where the scan already gives two tasks a core or the
    default parallelism is small; the decision rests on the plan's partition
    count, not on the data.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    have = df.rdd.getNumPartitions()
    if have >= want:
        return df
    return df.repartition(2 * want, *keys)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; set a local one only where none is set."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", "") or ""
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestrata-ckpt-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared checkpoint folder (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
