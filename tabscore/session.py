"""Session helpers: where shared scratch data goes and how small tables are joined."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows up to which a table counts as small enough to send to every executor.
BROADCAST_ROWS = 100_000
# Characters up to which a text in such a table counts as short.
BROADCAST_TEXT = 256

# Temporary folder per local application, where no shared folder is named.
_local_folders: dict[str, str | None] = {}


def get_spark(app: str = "tabscore", cores: str = "*", partitions: int | None = None, shared: str | None = None) -> SparkSession:
    """A session for tests and the bench; on a cluster pass your own session instead.

    ``shared`` is the folder for intermediate tables (``spark.checkpoint.dir``).
    """
    b = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shared is not None:
        b = b.config("spark.checkpoint.dir", shared)
    if partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def reach(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the library wherever the session was started; a cluster gets it by ``--py-files``."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names.

    Only a local session without that setting falls back to a temporary folder, which
    goes when the program ends; on a cluster a machine-local folder would be lost with its executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        base = _local_folders.setdefault(app, None) or tempfile.mkdtemp(prefix="tabscore-")
        if _local_folders[app] is None:
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        _local_folders[app] = base
    return f"{base.rstrip('/')}/tabscore/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder, in folders ``by`` columns, and read it back.

    Cuts the lineage, survives lost executors and keeps column pruning, which a
    row-format checkpoint would not.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path)


def join_lookup(big: DataFrame, lookup: DataFrame, on: list[str] | str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join to a keyed lookup table (one row per key).

    The lookup is fetched once, up to ``max_rows + 1`` rows: if it fits it is
    broadcast, otherwise both sides are shuffled and AQE splits skewed keys.
    """
    small = fetch_small(lookup, max_rows)
    if small is None:
        return big.join(lookup, on, "left")
    return big.join(F.broadcast(local_table(big.sparkSession, small)), on, "left")


def fetch_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> pa.Table | None:
    """The rows of a small table, or None for a larger one.

    Small is at most ``max_rows`` rows with texts of at most ``BROADCAST_TEXT`` characters: no
    more than the first characters of a text are fetched, so the bytes are bounded too.
    """
    texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    if any(isinstance(f.dataType, (T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)) for f in df.schema):
        return None
    cut = [F.substring(F.col(f"`{c}`"), 1, BROADCAST_TEXT + 1).alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns]
    table = df.select(*cut).limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return None
    longest = [pc.max(pc.utf8_length(table[c])).as_py() or 0 for c in table.column_names if c in texts]
    return table if max(longest, default=0) <= BROADCAST_TEXT else None


def local_table(spark: SparkSession, table: pa.Table) -> DataFrame:
    """A small table whose rows are part of the plan: no job and no Python worker reads it."""
    return spark.createDataFrame(table)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a scan that has fewer partitions than the session has cores.

    One small file is one task; heavy work per row would leave the other cores
    idle. A large table already has many partitions and is left as it is. Call it
    on a scan, before any shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
