"""Session defaults."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "cohortloom", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that ``spark.checkpoint.dir`` names; a local one only where the session names none."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="cohortloom-")
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: it is computed once, and survives a lost executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 10_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcasting if it has at most ``BROADCAST_ROWS`` rows, else as it is, for a join by shuffle. Count a settled table."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
