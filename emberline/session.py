"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest dimension (in rows) that may be broadcast or turned into an array literal.
# A million narrow rows is well below the 8 GB broadcast limit and fits any executor.
BROADCAST_ROWS = 1_000_000


def build_session(app: str, cpus: str | int = "*") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    partitions = "8" if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="emberline-warehouse-"))
        .getOrCreate()
    )


_scratch: list[str] = []


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder that every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``.  Only a local
    session without that setting gets a folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="emberline-")
    path = f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def remove_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables that this program has made; returns how many there were.

    For the end of a job: results that were not written elsewhere still read from them.
    """
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsparkSession.sessionState().newHadoopConf()
    names = [_scratch.pop() for _ in range(len(_scratch))]
    return sum(path(name).getFileSystem(conf).delete(path(name), True) for name in names)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors, so that their Python finds it wherever the driver was started.

    Spark serves the archive; not needed where it is installed or given by ``--py-files``.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="emberline-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; looks at one row beyond at most."""
    return df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table.  Built from Arrow, its size is known to the optimizer."""
    names = [field.split()[0] for field in schema.split(", ")]
    columns = {name: list(values) for name, values in zip(names, zip(*rows))}
    return spark.createDataFrame(pa.table(columns), schema)
