"""Session settings and the small runtime helpers every plan shares."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Bytes a query-side table may hold before it stops being broadcast.
BROADCAST_BYTES = 64 << 20
# Bytes of a row in a hash table besides its longest strings.
_ROW_BYTES = 96


def broadcastable(rows: int, widest: int | None) -> bool:
    """Whether ``rows`` rows, whose strings together have ``widest`` letters at most, are small."""
    return rows * (_ROW_BYTES + 4 * (widest or 0)) <= BROADCAST_BYTES

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys (one tenant, one api key, one user) are split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Word positions travel as compact arrays: small shuffles, a lot of work after.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Documents differ widely in length; blocks handed to Python are cut by size.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # Every top-k in this package uses literal caps of at most 800.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
    # JSON metadata follows the last-key-wins rule.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="rankloom-")) / "rankloom"
        made = shutil.make_archive(str(target), "zip", package.parent, package.name)
        context.addPyFile(made)
        _shipped.add(context.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Prepare an existing session: run-time settings, and this package on executors."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def build_session(app: str = "rankloom", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only when the session names none (local tests) is a scratch folder used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        if context.applicationId not in _scratch:
            _scratch[context.applicationId] = tempfile.mkdtemp(prefix="rankloom-shared-")
        folder = _scratch[context.applicationId]
    return folder.rstrip("/")


_scratch: dict[str, str] = {}


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
