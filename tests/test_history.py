import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from drayline.operators import history
from drayline.sources.keyed import DELETED, HashBuckets, KeyedTable
from drayline.sources.snapshots import SnapshotTable

START = datetime(2024, 1, 1)
LOG = "k long, t timestamp_ntz, v string, w int"


def log_rows(seed, hot):
    """Most rows of one key, many re-sent unchanged, some at equal times."""
    rng = random.Random(seed)
    rows = []
    for _ in range(600):
        k = 0 if rng.random() < hot else rng.randrange(1, 9)
        rows.append((k, START + timedelta(hours=rng.randrange(24 * 40)), rng.choice(["a", "a", "b", None]), rng.choice([1, 1, 2])))
    return rows


def plain_intervals(rows):
    newest = {}
    for k, t, v, w in rows:
        best = newest.get((k, t))
        order = lambda x: (x[0] is not None, x[0] or "", x[1])
        if best is None or order((v, w)) > order(best):
            newest[k, t] = (v, w)
    out, current = [], {}
    for (k, t), payload in sorted(newest.items()):
        if k in current and current[k][1] == payload:
            continue
        if k in current:
            out.append((k, *current[k][1], current[k][0], t))
        current[k] = (t, payload)
    return out + [(k, *payload, t, None) for k, (t, payload) in current.items()]


def sets(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("bucket", ["day", "month", "year"])
@pytest.mark.parametrize("hot", [0.1, 0.9])
def test_intervals_equal_a_walk_over_each_key(spark, bucket, hot):
    rows = log_rows(3, hot)
    odd = [(None, START, "x", 1), (1, None, "x", 1)]
    got = history.validity_intervals(spark.createDataFrame(rows + odd, LOG), ["k"], "t", bucket)
    assert sets(got, "k", "v", "w", "valid_from", "valid_to") == sorted(plain_intervals(rows), key=repr)


@pytest.mark.parametrize("bucket", ["day", "month"])
def test_as_of_finds_the_version_that_held(spark, bucket):
    rng, rows = random.Random(8), log_rows(4, 0.8)
    intervals = plain_intervals(rows)
    facts = [(i, rng.choice([0, 0, 1, 5, 77, None]), START + timedelta(hours=rng.randrange(-200, 24 * 60))) for i in range(300)] + [(999, 0, None)]
    facts += [(1000 + i, k, t) for i, (k, t, _, _) in enumerate(rows[:20])]  # at the very time of a version
    versions = spark.createDataFrame(intervals, "k long, v string, w int, valid_from timestamp_ntz, valid_to timestamp_ntz")
    got = history.as_of_join(spark.createDataFrame(facts, "id long, k long, at timestamp_ntz"), versions, ["k"], "at", bucket)

    def held(k, t):
        found = [i for i in intervals if t is not None and i[0] == k and i[3] <= t and (i[4] is None or t < i[4])]
        return found[0][1:] if found else (None,) * 4

    assert sets(got, "id", "k", "at", "v", "w", "valid_from", "valid_to") == sorted([(i, k, t, *held(k, t)) for i, k, t in facts], key=repr)


def test_no_pairs_are_formed_and_time_divides_a_key(spark, plan):
    df = spark.createDataFrame(log_rows(1, 0.9), LOG)
    versions = history.validity_intervals(df, ["k"], "t")
    for text in (plan(versions), plan(history.as_of_join(df.select("k", F.col("t").alias("at")), versions, ["k"], "at"))):
        assert "CartesianProduct" not in text and "NestedLoop" not in text and "EvalPython" not in text
        assert "_bucket" in text
    with pytest.raises(ValueError, match="too"):
        history.as_of_join(df, versions, ["k"], "t")
    with pytest.raises(ValueError, match="reserved"):
        history.validity_intervals(df.withColumn("valid_to", F.lit(1)), ["k"], "t")


def test_empty_history(spark):
    none = spark.createDataFrame([], LOG)
    assert history.validity_intervals(none, ["k"], "t").count() == 0
    facts = spark.createDataFrame([(1, START)], "k long, at timestamp_ntz")
    assert sets(history.as_of_join(facts, history.validity_intervals(none, ["k"], "t"), ["k"], "at"), "k", "v") == [(1, None)]


# --- Differences -------------------------------------------------------------------------------

STATE = "k long, v string, w int"


def states(seed):
    rng = random.Random(seed)
    before = {k: (rng.choice(["a", None]), rng.randrange(3)) for k in rng.sample(range(60), 40)}
    after = {k: v if rng.random() < 0.6 else (rng.choice(["a", "z", None]), 5) for k, v in before.items() if rng.random() < 0.8}
    after |= {k: ("new", None) for k in rng.sample(range(60, 90), 10)}
    return before, after


@pytest.mark.parametrize("seed", range(3))
def test_a_difference_applied_gives_the_later_state(spark, tmp_path, seed):
    before, after = states(seed)
    a, z = (spark.createDataFrame([(k, *v) for k, v in s.items()], STATE) for s in (before, after))
    feed = history.state_difference(a, z, ["k"])
    changes = {r.k: (r.change, (r.v, r.w)) for r in feed.collect()}
    assert changes == {
        k: ("delete", before[k]) if k not in after else ("insert" if k not in before else "update", after[k])
        for k in before.keys() | after.keys()
        if before.get(k) != after.get(k)
    }
    assert sets(history.apply_difference(a, feed, ["k"]), "k", "v", "w") == sets(z, "k", "v", "w")
    table = KeyedTable(spark, str(tmp_path / "k"), ["k"], HashBuckets(3))
    table.create(a)
    merged = table.merge(feed, deleted=F.col("change") == "delete", txn="f1")
    kinds = [c for c, _ in changes.values()]
    assert (merged.inserted, merged.updated, merged.deleted) == tuple(kinds.count(c) for c in ("insert", "update", "delete"))
    assert sets(table.read(), "k", "v", "w") == sets(z, "k", "v", "w") and table.read().columns == ["k", "v", "w"]
    assert table.merge(feed, deleted=F.col("change") == "delete", txn="f1").total == 0
    assert table.merge(feed, deleted=F.col("change") == "delete").deleted == 0  # deleting what is gone changes nothing
    assert sets(table.read(), "k", "v", "w") == sets(z, "k", "v", "w")


def test_deletes_keep_to_the_order_of_marks(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "k"), ["k"], HashBuckets(2))
    table.create(spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "c", 5)], STATE))
    changes = spark.createDataFrame([(1, None, 4, True), (2, None, 6, True), (3, "late", 3, None)], STATE + ", gone boolean")
    merged = table.merge(changes, latest_by="w", deleted="gone")
    assert (merged.updated, merged.deleted, merged.stale) == (0, 1, 2)
    assert sets(table.read(), "k", "v", "w") == [(1, "a", 5), (3, "c", 5)]
    with pytest.raises(ValueError, match="deletes nothing"):
        table.merge(changes, "append", deleted="gone")
    assert DELETED not in table.read().columns


def test_net_changes_of_a_log(spark, tmp_path):
    log = SnapshotTable(spark, str(tmp_path / "log"))
    log.create(spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], STATE))
    log.append(spark.createDataFrame([(1, "x", 2), (4, "d", 2)], STATE))
    log.append(spark.createDataFrame([(1, "a", 1), (2, "b", 1), (4, "e", 3), (3, "c", 0)], STATE))
    got = sets(history.log_difference(log, ["k"], "w", 1, 3), "k", "v", "w", "change")
    assert got == [(1, "x", 2, "update"), (4, "e", 3, "insert")]
    assert history.log_difference(log, ["k"], "w", 2, 3).count() == 1
