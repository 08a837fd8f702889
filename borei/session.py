"""Session construction and the few session-level services the operators need."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: dict[str, str] = {}


def build_session(app: str = "borei", master: str | None = None, cores: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` overrides any default."""
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",  # long texts: a batch stays small
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.appName(app)
    if master or cores:
        builder = builder.master(master or f"local[{cores}]")
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors once per application, so Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="borei-")) / "borei_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, Path(PACKAGE.name) / path.relative_to(PACKAGE))
    spark.sparkContext.addPyFile(str(target))
    _shipped[app] = str(target)


def on_texts(column: Column, *texts: str | None, spark: SparkSession | None = None) -> list:
    """What an expression over a column ``text`` gives for single texts, for use at a prompt."""
    spark = spark or SparkSession.getActiveSession() or build_session()
    ship(spark)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", column.alias("x"))
    return [r.x for r in sorted(rows.collect(), key=lambda r: r.i)]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``. Only where everything runs in one process, as in
    tests, a private folder stands for one that isn't set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return os.path.join(tempfile.gettempdir(), f"borei-checkpoints-{os.getpid()}")


def use_checkpoints(spark: SparkSession) -> None:
    """Point checkpoint() at the shared folder, unless the session has done so."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the scan has too few splits to feed them (one small file, one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table of a test folder with only the named columns."""
    ship(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
