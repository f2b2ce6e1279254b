from tidegauge.streaming.online import OnlineTable

LAYOUT = "k int, t int, v string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), LAYOUT)


def found(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_batches_compaction_and_snapshots(spark, tmp_path):
    online = OnlineTable(spark, str(tmp_path / "o"), ["k"], ["t"])
    assert online.read() is None and not online.compact()
    assert online.add(rows(spark, (1, 1, "a"), (2, 5, "b"), (1, 2, "c")), "s", 0)
    assert not online.add(rows(spark, (1, 9, "again")), "s", 0)  # the batch was seen
    assert online.add(rows(spark, (1, 3, "d")), "s", 1)
    before = online.manifest()
    assert found(online.read()) == [(1, 3, "d"), (2, 5, "b")]
    assert online.compact() and len(online.manifest()["folders"]) == 1
    assert not online.add(rows(spark, (1, 9, "again")), "s", 1)  # compaction remembers the batches
    assert found(online.read()) == found(online.read(before)) == [(1, 3, "d"), (2, 5, "b")]
    assert online.add(rows(spark, (3, 1, "e")), "other", 0)
    assert found(online.read()) == [(1, 3, "d"), (2, 5, "b"), (3, 1, "e")]
    assert online.clean(keep=1) == 2
    assert found(online.read()) == [(1, 3, "d"), (2, 5, "b"), (3, 1, "e")]


def test_a_batch_added_while_compacting_is_kept(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "o")
    online, other = (OnlineTable(spark, path, ["k"], ["t"]) for _ in range(2))
    online.add(rows(spark, (1, 1, "a")), "s", 0)
    online.add(rows(spark, (2, 1, "b")), "s", 1)
    publish, calls = OnlineTable._publish, []

    def late(self, manifest):
        if self is online and not calls:
            calls.append(1)
            other.add(rows(spark, (1, 2, "new")), "s", 2)
        return publish(self, manifest)

    monkeypatch.setattr(OnlineTable, "_publish", late)
    assert online.compact()
    assert len(online.manifest()["folders"]) == 2 and online.manifest()["batches"] == {"s": 2}
    assert found(online.read()) == [(1, 2, "new"), (2, 1, "b")]
