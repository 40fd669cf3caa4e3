"""Session-level helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach for cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. Only where that setting and the
    context's own checkpoint folder are both missing (a local test session) is a
    temporary folder made.
    """
    sc = spark.sparkContext
    own = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="hypomill-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    A lost executor cannot lose the written table, and a stage that is read several times
    is computed once. Tables are removed by ``free``, at the latest when the
    driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a table counts as small enough to be sent to every executor.
SMALL_ROWS = 100_000


def bounded_broadcast(df: DataFrame, name: str = "small", most: int = SMALL_ROWS) -> DataFrame:
    """``df`` written once and, if it has at most ``most`` rows, marked for broadcast.

    A larger one comes back unmarked: its join then shuffles, and AQE splits hot keys.
    """
    written = materialize(df, name)
    small = written.limit(most + 1).count() <= most
    return F.broadcast(written) if small else written


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give every Python worker this package, wherever the driver imported it from."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="hypomill-ship-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(target))
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
    _shipped.add(sc.applicationId)


def free() -> None:
    """Remove all tables written so far.

    A long session calls it between queries, once their results are read or written; at the
    driver's end it is called anyway.
    """
    while _written:
        spark, path = _written.pop()
        try:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session may already be gone
            pass


atexit.register(free)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
