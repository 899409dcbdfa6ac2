"""Connectors: broker and JDBC options, record codecs, replaced tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from topicscope.sources.connectors import (jdbc_read_options, jdbc_write_options, kafka_options, kafka_records,
                                           read_kafka, read_or_empty, replace_table)
from topicscope.streaming.ingest import kafka_envelope



def test_kafka_options_plain_and_sasl():
    assert kafka_options({}) == {"kafka.bootstrap.servers": "localhost:9092",
                                 "kafka.security.protocol": "PLAINTEXT"}
    o = kafka_options({"KAFKA_BOOTSTRAP": "b:1", "KAFKA_SECURITY_PROTOCOL": "SASL_SSL",
                       "KAFKA_SASL_USERNAME": "u", "KAFKA_SASL_PASSWORD": 'p"w'})
    assert o["kafka.sasl.mechanism"] == "SCRAM-SHA-256"
    assert 'username="u"' in o["kafka.sasl.jaas.config"]
    assert 'password="p\\"w"' in o["kafka.sasl.jaas.config"]
    assert "ScramLoginModule" in o["kafka.sasl.jaas.config"]


def test_kafka_codecs_without_broker(spark):
    df = spark.createDataFrame(
        [("hackernews", "1", "t", "", "u", "a", 1, dt.datetime(2024, 1, 1))],
        "source string, external_id string, title string, text string, url string, "
        "author string, score int, created_at timestamp_ntz")
    rec = kafka_records(df).first()
    assert rec.key == "hackernews:1" and json.loads(rec.value)["external_id"] == "1"
    k = spark.createDataFrame([(0, 5, bytearray(rec.value.encode()))],
                              "partition int, offset long, value binary")
    env = kafka_envelope(k).first()
    assert (env.seq, env.pos, env.value) == (0, [0, 5], rec.value)
    timed = k.withColumn("timestamp", F.timestamp_micros(F.lit(123)))
    assert kafka_envelope(timed).first().seq == 123


def test_kafka_reader_reports_missing_connector(spark):
    with pytest.raises(RuntimeError):
        read_kafka(spark, mode="batch")


def test_jdbc_options():
    # no database is started here: the options a scan / write would use are checked
    r = jdbc_read_options("jdbc:postgresql://db/x", "api_post",
                          partition={"column": "id", "lowerBound": 0, "upperBound": 10 ** 6,
                                     "numPartitions": 64}, properties={"user": "u"})
    assert r == {"url": "jdbc:postgresql://db/x", "dbtable": "api_post", "user": "u",
                 "partitionColumn": "id", "lowerBound": "0", "upperBound": "1000000",
                 "numPartitions": "64"}
    with pytest.raises(ValueError):
        jdbc_read_options("u", "t", partition={"column": "id"})
    w = jdbc_write_options("jdbc:postgresql://db/x", "spark_trends")
    assert w["truncate"] == "true"
    assert "truncate" not in jdbc_write_options("u", "t", mode="append")


def test_replace_table_and_read_or_empty(spark, scratch):
    base = f"{scratch}/trends"
    empty = read_or_empty(spark, base, "term string, count long")
    assert empty.count() == 0 and empty.columns == ["term", "count"]
    for rows in ([("a", 1)], [("b", 2), ("c", 3)], [], [("d", 4)]):
        assert replace_table(spark.createDataFrame(rows, "term string, count long"), base) == base
        got = read_or_empty(spark, base, "term string, count long")
        assert sorted(tuple(r) for r in got.collect()) == rows and got.columns == ["term", "count"]
    with pytest.raises(Exception):                                        # only a missing table is empty (Q12)
        read_or_empty(spark, base, "no ddl at all,")


def test_a_table_may_be_replaced_from_itself(spark, scratch):
    base = f"{scratch}/t"
    replace_table(spark.range(5), base)
    rows = read_or_empty(spark, base, "id long")
    replace_table(rows.filter("id > 2").withColumn("id", F.col("id") * 10), base)
    assert sorted(r.id for r in read_or_empty(spark, base, "id long").collect()) == [30, 40]


def test_a_failed_replace_keeps_the_old_rows(spark, scratch):
    base = f"{scratch}/t"
    replace_table(spark.range(5), base)
    with pytest.raises(Exception):
        replace_table(spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")).alias("id")), base)
    assert read_or_empty(spark, base, "id long").count() == 5
