"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str | None = None, app: str = "weft") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the given session."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="weft-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else one below the warehouse."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/weft-scratch"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/weft-{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    A written table is computed once (an eager checkpoint runs its plan twice), survives lost
    executors, and starts the next round from a plain scan without inherited constraints,
    which would otherwise multiply over the rounds of an iteration.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Written tables of an iteration, of which only the last two rounds stay on the shared disk.

    A round reads the tables of the one before, whose own lineage ends at its files; so what is older serves
    nobody, whichever executor is lost. ``kept`` tables are the result and stay.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.rounds = spark, [[]]

    def cut(self, df: DataFrame) -> DataFrame:
        """``df`` written and read again, as a table of this round."""
        path = scratch_path(self.spark, "table")
        df.write.parquet(path)
        self.rounds[-1].append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def next(self) -> None:
        """A new round begins; the tables of the round before the last are removed."""
        self.rounds.append([])
        for path in self.rounds[-3] if len(self.rounds) > 2 else []:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path).getParent()  # the folder made for this table alone
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes of input files for one task of heavy work per row.
PART = 32 << 20


def parts_of(df: DataFrame) -> int:
    """Tasks for heavy work on the rows of ``df``: as many as there are cores, and more where its files are large."""
    spark = df.sparkSession
    jvm, conf, size = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for name in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return max(spark.sparkContext.defaultParallelism, -(-size // PART))


def widen(df: DataFrame, key: str) -> DataFrame:
    """Spread a table that sits in fewer files than there are cores, before heavy work per row.

    The parts grow in number with the files, so that no task grows with the table. A table of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts_of(df), key) if len(df.inputFiles()) < cores else df
