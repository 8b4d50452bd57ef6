import itertools
import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import at
from pyspark.sql import functions as F

from sensorlake.sources import ledger
from sensorlake.sources.ledger import Ledger

KIND = "ts timestamp_ntz, node_id string, v double, n int"


@pytest.fixture
def table(spark, tmp_path):
    return Ledger(spark, str(tmp_path / "t"), ["ts", "node_id"], ["n"])


def rows_of(spark, rows):
    return spark.createDataFrame([(at(m), node, v, n) for m, node, v, n in rows], KIND)


def content(table, **how):
    return sorted((r.ts, r.node_id, r.v, r.n) for r in table.read(**how).collect())


def test_last_row_stays_and_is_taken_whole(spark, table):
    table.upsert(rows_of(spark, [(0, "M1", 1.0, 0), (60 * 24, "M1", 5.0, 0)]))
    table.upsert(rows_of(spark, [(0, "M1", 2.0, 2), (0, "M1", None, 3), (3, "M1", 4.0, None)]))
    assert content(table) == [(at(0), "M1", None, 3), (at(3), "M1", 4.0, None), (at(1440), "M1", 5.0, 0)]
    assert content(table, version=0) == [(at(0), "M1", 1.0, 0), (at(1440), "M1", 5.0, 0)]
    # An older order in a later delta still wins: later writes replace earlier ones.
    table.upsert(rows_of(spark, [(0, "M1", 7.0, 1)]))
    assert content(table)[0] == (at(0), "M1", 7.0, 1)
    assert content(table, days=("2024-03-02", "2024-03-02")) == [(at(1440), "M1", 5.0, 0)]


class Killed(BaseException):
    pass


@pytest.mark.parametrize("step", ["write", "written", "stage", "link", "linked", "done"])
def test_a_writer_killed_at_any_step_loses_nothing(spark, table, monkeypatch, step):
    old, new = [(0, "M1", 1.0, 0), (3, "M1", 2.0, 0)], [(0, "M1", 9.0, 1), (6, "M4", 3.0, 0)]
    table.upsert(rows_of(spark, old), "s", 0)
    before = content(table)

    def killed(*_, **__):
        raise Killed

    write, commit, link = Ledger._write, Ledger._commit, os.link
    with monkeypatch.context() as m:
        if step == "write":
            m.setattr(Ledger, "_write", killed)
        elif step == "written":
            m.setattr(Ledger, "_write", lambda self, rows: (write(self, rows), killed()))
        elif step == "stage":
            m.setattr(Ledger, "_commit", killed)
        elif step == "link":
            m.setattr(ledger.os, "link", killed)
        elif step == "linked":
            m.setattr(ledger.os, "link", lambda a, b: (link(a, b), killed()))
        else:
            m.setattr(Ledger, "_commit", lambda self, s: (commit(self, s), killed()))
        with pytest.raises(Killed):
            table.upsert(rows_of(spark, new), "s", 1)
    assert content(table) == before if step not in ("linked", "done") else len(content(table)) == 3
    # The replay of the batch, twice.
    table.upsert(rows_of(spark, new), "s", 1)
    version = table.upsert(rows_of(spark, new), "s", 1)["version"]
    assert content(table) == [(at(0), "M1", 9.0, 1), (at(3), "M1", 2.0, 0), (at(6), "M4", 3.0, 0)]
    assert version == 1 and len(table.snapshot()["deltas"]) == 2


def test_writers_do_not_collide(spark, table):
    def write(i):
        own = Ledger(spark, table.path, ["ts", "node_id"], ["n"])
        for k in range(3):
            own.upsert(rows_of(spark, [(i, f"w{i}", float(k), k)]), f"w{i}", k)
        return own.compact(fan_in=4)

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(write, range(6)))
    assert content(table) == [(at(i), f"w{i}", 2.0, 2) for i in range(6)]
    assert table.versions() == list(range(table.versions()[-1] + 1))
    assert table.snapshot()["streams"] == {f"w{i}": 2 for i in range(6)}


def test_compaction_keeps_content_and_versions(spark, table):
    rng = random.Random(3)
    want = {}
    for batch in range(11):
        rows = [(rng.randrange(0, 4000, 100), f"M{rng.randrange(3)}", float(batch), i) for i in range(6)]
        table.upsert(rows_of(spark, rows))
        for m, node, v, n in rows:
            want[m, node] = (at(m), node, v, n)
    expected = sorted(want.values())
    assert content(table) == expected
    assert table.compact(fan_in=3) >= 3
    classes = [d["size_class"] for d in table.snapshot()["deltas"]]
    assert classes == sorted(classes, reverse=True) and len(classes) <= 5
    assert content(table) == expected
    assert table.vacuum(keep_versions=1, older_than_s=3600) == 0
    assert table.vacuum(keep_versions=1, older_than_s=-10) > 0
    assert content(table) == expected and len(table.versions()) == 1


def test_compaction_gives_way_to_a_replacement(spark, table, monkeypatch):
    for i in range(2):
        table.upsert(rows_of(spark, [(i, "M1", float(i), 0)]))
    write = Ledger._write

    def write_then_replaced(self, rows):
        name = write(self, rows)
        monkeypatch.setattr(Ledger, "_write", write)
        Ledger(spark, table.path, ["ts", "node_id"], ["n"]).replace(rows_of(spark, [(9, "M9", 9.0, 9)]))
        return name

    monkeypatch.setattr(Ledger, "_write", write_then_replaced)
    table.compact(fan_in=2)
    assert content(table) == [(at(9), "M9", 9.0, 9)]


def test_new_columns_retention_and_replacement(spark, table):
    table.upsert(rows_of(spark, [(0, "M1", 1.0, 0), (3 * 1440, "M1", 2.0, 0)]))
    table.upsert(rows_of(spark, [(4 * 1440, "M1", 3.0, 0)]).withColumn("extra", F.lit("x")))
    assert [r.extra for r in table.read().orderBy("ts").collect()] == [None, None, "x"]
    table.drop_before("2024-03-02")
    assert len(table.drop_before("2024-03-01")["deltas"]) == 2
    assert table.read().count() == 2
    # The new content is read from the table itself.
    table.replace(table.read().filter("v > 2").drop("extra"))
    assert content(table) == [(at(4 * 1440), "M1", 3.0, 0)]
    with pytest.raises(ValueError):
        table.upsert(rows_of(spark, []).withColumn("day", F.lit(1)))


def test_empty_batches_and_missing_tables(spark, table):
    with pytest.raises(FileNotFoundError):
        table.read()
    table.upsert(rows_of(spark, []))
    assert content(table) == []
    assert table.compact() == 0
