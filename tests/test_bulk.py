from datetime import datetime, timedelta

from pyspark.sql import functions as F

from factloom.ingest.bulk import fold_new
from factloom.ingest.job import empty_state, fold_groups, with_payload
from factloom.plans.queries import QUERIES

NOTES = "uuid string, group_id string, content string, valid_at timestamp_ntz, created_at timestamp_ntz"
APART = [
    "Ann joined Acme", "Bob joined acme", "Bob likes Acme", "Bob joined Acme", "Ann left Acme", "Ann  joined  acme", "nothing is said", None, "Cid likes Globex and Cid joined Acme",
    "Cid left Globex", "Bob joined Globex", "Ann joined Globex", "Ann joined Acme", "Bob left Globex", "Dee likes Globex", "Dee likes Initech", "王小明在华为工作", "李四喜欢华为", "X likes Acme", "Ann likes Y",
]


def notes(spark, *groups):
    start = datetime(2024, 1, 1, 8)
    rows = [(f"{g}-{k % 7}-{k}", g, text, start + timedelta(hours=7 * (k // 2), milliseconds=k % 2), start + timedelta(hours=5 * (k // 2))) for g, texts in groups for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, NOTES)


def rows(changes):
    return sorted((tuple(r) for r in changes.collect()), key=str)


GROUPS = [
    APART, APART * 3, APART[::-1],
    ["Ann likes Bob", "Bob likes Cid", "Cid joined Acme", "Ann joined Acme", "Bob left Acme"],  # a source is at another end
    ["Ann joined Acme and Bob joined Acme", "Bob left Acme", "Ann likes Acme"],  # a note of two sources
    ["Ann joined Acme", "ann joined acme", "Bob joined Acme"],  # one key, and something is said only once
    ["nothing"], [None, None],
]


def test_parts_make_what_groups_make(spark):
    own = notes(spark, *((f"g{k}", texts) for k, texts in enumerate(GROUPS)))
    assert rows(fold_new(own)) == rows(fold_groups(with_payload(own), empty_state(spark)))


def test_the_sources_of_a_group_are_folded_by_several_tasks(spark):
    facts = QUERIES["ingest_fold"](spark, "/root/testdata/sf0.001").where("kind = 'fact'").select("group_id", F.spark_partition_id().alias("task"))
    tasks = facts.groupBy("group_id").agg(F.count_distinct("task").alias("n")).collect()
    assert max(r.n for r in tasks) > 1  # a group was one task


def test_a_note_without_an_instant(spark):
    own = notes(spark, ("g1", APART)).withColumn("valid_at", F.when(F.col("content") != "Bob likes Acme", F.col("valid_at")))
    assert rows(fold_new(own)) == rows(fold_groups(with_payload(own), empty_state(spark)))
