"""What near-duplicate detection shuffles, and how many jobs it starts."""

import random
from collections import Counter

import pytest

from gapwise.llm import minhash
from gapwise.llm.common import Scratch
from gapwise.llm.components import connected_components


def shuffled_rows(spark, act):
    """Rows that act() shuffles."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    before = stages()
    act()
    return sum(rows for stage, rows in stages().items() if stage not in before)


def tasks(spark, act):
    """The number of tasks that act() runs where shuffles have 40 partitions, and what it returns."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).numCompleteTasks() for k in range(found.size())}

    hot = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in hot}
    before = stages()
    for k, v in hot.items():
        spark.conf.set(k, v)
    try:
        out = act()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    return sum(n for stage, n in stages().items() if stage not in before), out


def jobs(spark, act):
    """The number of jobs that act() starts, and what it returns."""
    sc = spark.sparkContext
    sc.setJobGroup("counted", "")
    before = len(sc.statusTracker().getJobIdsForGroup("counted"))
    out = act()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    count = len(sc.statusTracker().getJobIdsForGroup("counted")) - before
    sc.setLocalProperty("spark.jobGroup.id", None)
    return count, out


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_repeated_buckets(spark, size):
    """All rows of buckets with several are passed on, hot ones too, and few others; batches may be short."""
    r = random.Random(4)
    rows = [(r.randrange(-400, 400), k) for k in range(600)] + [(7, 1000 + k) for k in range(500)]
    count = Counter(b for b, _ in rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = [tuple(x) for x in minhash.repeated(spark.createDataFrame(rows, "bucket long, row long")).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {x for x in rows if count[x[0]] > 1}
    assert len(got) == len(set(got)) and want <= set(got) <= set(rows)
    assert len(got) - len(want) <= 2 * 4
    assert minhash.repeated(spark.createDataFrame([], "bucket long, row long")).count() == 0


def test_band_rows_are_shuffled_once(spark):
    """Texts that share no bucket: without broadcasts too, each (bucket, row) goes over the network once."""
    r = random.Random(6)
    docs = spark.createDataFrame([(k, " ".join(f"w{r.random()}" for _ in range(12))) for k in range(300)], "doc_id long, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = shuffled_rows(spark, lambda: minhash.near_duplicates(docs, 3, 85).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    bands = 300 * minhash.band_count(85)
    assert bands <= rows < 1.6 * bands


def test_few_jobs_without_links(spark):
    """Stars need no round of components, and no links none of their steps."""
    edges = spark.createDataFrame([(k, 100 * (k // 100)) for k in range(1, 500)], "a long, b long")
    count, got = jobs(spark, lambda: connected_components(edges, Scratch(spark, "t"), "c").collect())
    assert {x.node: x.root for x in got} == {k: 100 * (k // 100) for k in range(500)}
    assert count <= 10
    roots = connected_components(edges, Scratch(spark, "t"), "c")
    links = spark.createDataFrame([], "g long, m long")
    count, got = jobs(spark, lambda: minhash._united(roots, links, Scratch(spark, "t"), "u"))
    assert count <= 3 and got.count() == 500


def test_few_tasks_of_components(spark):
    """A turn's tables are stored, so none is computed or shuffled twice, and one aggregate tells that there is no more to do."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 90) if k % 30 < 25], "a long, b long")
    count, got = tasks(spark, lambda: connected_components(edges, Scratch(spark, "t"), "c").collect())
    assert {x.node: x.root for x in got} == {k: 30 * (k // 30) for k in range(90) if k % 30 < 26}
    assert len(got) == 78
    assert count <= 1000


def test_grown_heap_is_collected(spark, monkeypatch):
    """After a table, the driver collects its garbage if its heap is over the share."""
    swept, rows = [], spark.range(3)
    monkeypatch.setattr(Scratch, "sweep", lambda self: swept.append(1))
    monkeypatch.setattr(Scratch, "HEAP_SHARE", 2)
    assert Scratch(spark, "t").save(rows, "a").count() == 3 and not swept
    monkeypatch.setattr(Scratch, "HEAP_SHARE", 0)
    assert Scratch(spark, "t").save(rows, "a").count() == 3 and swept == [1]
