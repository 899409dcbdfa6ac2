"""Connectors: broker, JDBC and table paths (O-05..O-09, O-15..O-17).

The broker connector needs the ``spark-sql-kafka`` package on the classpath;
it is not bundled here, so the readers fail with a clear message when it is
missing.  The option builder and the codecs work without it.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import POST_KEY

DEFAULT_TOPIC = "raw.posts"


# --- O-07 ------------------------------------------------------------------------
def kafka_options(env: dict | None = None) -> dict[str, str]:
    """Connection options from the environment: bootstrap servers, security
    protocol and, only for SASL protocols, mechanism + JAAS login."""
    env = dict(os.environ if env is None else env)
    opts = {"kafka.bootstrap.servers": env.get("KAFKA_BOOTSTRAP", "localhost:9092")}
    proto = env.get("KAFKA_SECURITY_PROTOCOL", "PLAINTEXT")
    opts["kafka.security.protocol"] = proto
    if proto.startswith("SASL"):
        mech = env.get("KAFKA_SASL_MECHANISM", "SCRAM-SHA-256")
        user = env.get("KAFKA_SASL_USERNAME", "")
        pwd = env.get("KAFKA_SASL_PASSWORD", "")
        module = ("org.apache.kafka.common.security.plain.PlainLoginModule" if mech == "PLAIN"
                  else "org.apache.kafka.common.security.scram.ScramLoginModule")
        esc = (lambda s: s.replace("\\", "\\\\").replace('"', '\\"'))
        opts["kafka.sasl.mechanism"] = mech
        opts["kafka.sasl.jaas.config"] = (f'{module} required username="{esc(user)}" '
                                          f'password="{esc(pwd)}";')
    return opts


def _kafka_available(spark: SparkSession) -> bool:
    try:
        spark._jvm.java.lang.Class.forName(
            "org.apache.spark.sql.kafka010.KafkaSourceProvider")
        return True
    except Exception:  # noqa: BLE001
        return False


# --- O-05 / O-06 -------------------------------------------------------------------
def read_kafka(spark: SparkSession, mode: str = "stream", topic: str | None = None,
               env: dict | None = None, max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Broker scan from the earliest offset: ``mode='batch'`` reads earliest->latest
    once; ``mode='stream'`` keeps offsets in the query checkpoint."""
    if not _kafka_available(spark):
        raise RuntimeError("the Kafka connector (spark-sql-kafka) is not on the classpath")
    topic = topic or (env or os.environ).get("KAFKA_TOPIC", DEFAULT_TOPIC)
    opts = {**kafka_options(env), "subscribe": topic, "startingOffsets": "earliest"}
    if mode == "batch":
        return spark.read.format("kafka").options(**opts, endingOffsets="latest").load()
    if mode != "stream":
        raise ValueError("mode must be 'batch' or 'stream'")
    if max_offsets_per_trigger:
        opts["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return spark.readStream.format("kafka").options(**opts).load()


# --- O-15 -----------------------------------------------------------------------------
def kafka_records(posts: DataFrame) -> DataFrame:
    """``(key, value)`` records: key = source and external id, so the deliveries
    of one post stay in one partition and a large source is spread over all,
    value = wire JSON."""
    from .decode import encode_posts
    key = F.concat_ws(":", F.col("source"), F.col("external_id"))
    return posts.select(key.alias("key"), encode_posts(posts).alias("value"))


def write_kafka(posts: DataFrame, topic: str | None = None, env: dict | None = None) -> None:
    spark = posts.sparkSession
    if not _kafka_available(spark):
        raise RuntimeError("the Kafka connector (spark-sql-kafka) is not on the classpath")
    topic = topic or (env or os.environ).get("KAFKA_TOPIC", DEFAULT_TOPIC)
    (kafka_records(posts).write.format("kafka").options(**kafka_options(env))
     .option("topic", topic).save())


# --- O-08 / O-16 -------------------------------------------------------------------------
def jdbc_read_options(url: str, table: str, partition: dict | None = None,
                      properties: dict | None = None) -> dict[str, str]:
    """Options of a JDBC scan; ``partition`` = ``{'column', 'lowerBound',
    'upperBound', 'numPartitions'}`` splits the scan into range queries (the
    reference reads the whole table in one task)."""
    opts = {"url": url, "dbtable": table, **{k: str(v) for k, v in (properties or {}).items()}}
    if partition:
        missing = {"column", "lowerBound", "upperBound", "numPartitions"} - set(partition)
        if missing:
            raise ValueError(f"partition spec lacks {sorted(missing)}")
        opts.update(partitionColumn=partition["column"], lowerBound=str(partition["lowerBound"]),
                    upperBound=str(partition["upperBound"]),
                    numPartitions=str(partition["numPartitions"]))
    return opts


def jdbc_write_options(url: str, table: str, mode: str = "overwrite",
                       properties: dict | None = None) -> dict[str, str]:
    """Options of a JDBC write; an overwrite truncates (keeps the table
    definition) instead of drop + create."""
    opts = {"url": url, "dbtable": table, **{k: str(v) for k, v in (properties or {}).items()}}
    if mode == "overwrite":
        opts["truncate"] = "true"
    return opts


def read_jdbc(spark: SparkSession, url: str, table: str, columns: list[str] | None = None,
              partition: dict | None = None, properties: dict | None = None) -> DataFrame:
    """JDBC scan; the selected columns and later filters are pushed into the SELECT."""
    df = spark.read.format("jdbc").options(**jdbc_read_options(url, table, partition,
                                                               properties)).load()
    return df.select(*columns) if columns else df


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "overwrite",
               properties: dict | None = None) -> None:
    df.write.format("jdbc").options(**jdbc_write_options(url, table, mode, properties)) \
        .mode(mode).save()


# --- O-09 / O-17: tables on a path, by Spark's writers ---------------------------------------
#: The partition that holds a result table's rows.
PART = "part"


def read_if_there(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The parquet table at ``path``, or an empty one with ``schema`` where nothing was written yet.
    Other errors are raised (Q12)."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as ex:
        if ex.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def overwrite_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions of ``df`` in the table at ``path``; others stay (dynamic overwrite).

    The new files are written aside and take the partitions' places when the job commits, so ``df`` may
    read the table itself, and a job that fails before its commit changes nothing.  Plain parquet has no
    transactions: the commit itself is a rename for each partition.  On a table format use its own
    ``MERGE INTO`` or ``INSERT OVERWRITE``.
    """
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def replace_table(df: DataFrame, path: str) -> str:
    """O-17: the table at ``path`` holds the rows of ``df`` from now on; readers see the old rows while the new
    ones are computed and written.  Returns ``path``."""
    obs = Observation()
    overwrite_partitions(df.observe(obs, F.count(F.lit(1)).alias("n")).withColumn(PART, F.lit("all")), path, PART)
    if not obs.get["n"]:                            # no partition to put in the old one's place
        df.limit(0).withColumn(PART, F.lit("all")).write.mode("overwrite").partitionBy(PART).parquet(path)
    return path


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """O-09: a result table written by ``replace_table``, or an empty table with ``schema`` when it
    does not exist yet."""
    return read_if_there(spark, path, schema).drop(PART)


__all__ = ["kafka_options", "read_kafka", "kafka_records", "write_kafka", "read_jdbc", "write_jdbc",
           "replace_table", "read_or_empty", "read_if_there", "overwrite_partitions", "POST_KEY"]
