import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayline import session
from drayline.sources.ledger import KEPT, Ledger

SCHEMA = T.StructType().add("n", "long").add("t", "string")


def state(spark, n):
    return spark.range(n).select(F.col("id").alias("n"), F.lit("x").alias("t"))


def test_states_replace_each_other_and_old_ones_go(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), SCHEMA)
    assert ledger.sequence() == 0 and ledger.read().count() == 0 and ledger.greatest("n", 0) is None
    for i in range(KEPT + 3):
        ledger.replace(state(spark, i + 1), i)
    assert ledger.sequence() == KEPT + 3
    assert ledger.read().count() == KEPT + 3
    assert ledger.greatest("n", KEPT + 3).n == KEPT + 2
    assert len(os.listdir(tmp_path / "l")) == KEPT


def test_a_state_can_be_built_from_the_one_in_force(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), SCHEMA)
    ledger.replace(state(spark, 1), 0)
    for i in range(1, 4):
        ledger.replace(ledger.read().unionByName(state(spark, 1)), i)
    assert ledger.read().count() == 4


def test_a_torn_write_leaves_the_state_in_force(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), SCHEMA)
    ledger.replace(state(spark, 2), 0)
    torn = tmp_path / "l" / "state-2" / "_temporary" / "0"
    torn.mkdir(parents=True)
    (torn / "part-00000.parquet").write_bytes(b"half")
    assert ledger.sequence() == 1 and ledger.read().count() == 2
    ledger.replace(state(spark, 5), 1)
    assert ledger.sequence() == 2 and ledger.read().count() == 5


def test_workspace_follows_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    one, two = session.workspace(spark, "a"), session.workspace(spark, "a")
    assert one.startswith(root + "/drayline/a-") and one != two


class Cluster:
    """A session as a cluster would have it, without a shared folder or a database."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return {"spark.master": "yarn"}.get(key, default)


def test_a_cluster_needs_a_shared_folder_and_a_database():
    from drayline.plans import catalog

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_root(Cluster)
    with pytest.raises(ValueError, match="spark.drayline.jdbc.url"):
        catalog.database(Cluster)
