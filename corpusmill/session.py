"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings an application would start with; a cluster's own values win over them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]")
    for key, value in (DEFAULTS | {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"} | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the Python workers, once an application, so that they can import it wherever the
    driver was started."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="corpusmill-")) / "corpusmill-source.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def tune(spark: SparkSession, records: int = 2048, size: int = 32 << 20) -> None:
    """Bound the Arrow batches in rows and bytes, so that a batch of long texts fits beside the executor's heap."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= records:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own; a cluster without it is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = context._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


_WRITTEN: list[str] = []


@atexit.register
def _clean_up() -> None:
    """Tables in a folder of the local file system go with the process; elsewhere the folder's owner clears it."""
    for path in _WRITTEN:
        if path.startswith(("/", "file:/")):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def spread(scan: DataFrame) -> DataFrame:
    """``scan``, which only reads files, over all cores if it has splits for less than half of them: a small table in one
    file would else keep one core busy. Larger tables stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if 2 * scan.rdd.getNumPartitions() < cores else scan


def forget_at_exit(*paths: str) -> None:
    """Tables at ``paths`` go with the process, where they are local."""
    _WRITTEN.extend(paths)


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"
    forget_at_exit(path)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
