import random
from datetime import datetime, timedelta

import pytest

from factloom.ingest.job import empty_state, fold_groups, next_state, with_payload
from factloom.streaming.keyed import current, start_keyed

SCHEMA = "uuid string, group_id string, content string, valid_at timestamp_ntz, created_at timestamp_ntz"


def notes(seed, many):
    rng = random.Random(seed)
    start, rows = datetime(2024, 1, 1), []
    for k in range(many):
        who, firm = rng.choice(["Ann", "Bob", "Carol"]), rng.choice(["Acme", "Globex", "Initech"])
        text = rng.choice([f"{who} works at {firm}", f"{who} left {firm}", f"{who} likes {firm}", f"{who} joined {firm}", f"{who} joined {firm} and Bob likes Acme", "nothing"])
        rows.append((f"n{k:03}", f"g{k % 3}", text, start + timedelta(days=rng.randrange(60)), start + timedelta(days=100 + k)))
    return rows


@pytest.mark.parametrize("seed", [1])
def test_equal_to_the_batch_fold_after_restarts(spark, tmp_path, seed):
    def all_end(statement, shown):
        return True

    rows = notes(seed, 60)
    source, log = tmp_path / "in", f"file://{tmp_path}/log"
    for part in range(3):  # a file, a run to its end, a restart
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        query = start_keyed(stream, log, f"file://{tmp_path}/check", all_end)
        query.awaitTermination(240)
        assert query.exception() is None and not query.isActive
    want = next_state(empty_state(spark), fold_groups(with_payload(spark.createDataFrame(rows, SCHEMA)), empty_state(spark), all_end))
    plain = lambda df: sorted(map(tuple, df.select("kind", "group_id", "row").collect()))
    got = plain(current(spark, log))
    assert got == plain(want)
    assert sum(r[0] == "fact" for r in got) > 10 and any('"closedByEpisode' in r[2].replace("\\", "") for r in got)
