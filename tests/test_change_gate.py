"""The change gate in order, in bounded memory, over restarts."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetlens.streaming import gate


def frames(rows, size):
    table = pd.DataFrame(rows, columns=["sha", "micros", "tie"])
    return [table.iloc[n : n + size] for n in range(0, len(table), size)]


@pytest.mark.parametrize("count, size, held", [(0, 5, 5), (1, 5, 5), (500, 7, 10_000), (300, 3, 3), (400, 2, 20)])
def test_external_sort(monkeypatch, count, size, held):
    """A hundred runs at a fan-in of four fill more than two levels."""
    monkeypatch.setattr(gate, "FAN_IN", 4)
    random.seed(count)
    rows = [(str(n), random.choice([gate.NO_PLACE, *range(40)]), random.choice([gate.NO_PLACE, *range(90)])) for n in range(count)]
    seen = [tuple(r) for f in gate.in_order(frames(rows, size), held) for r in f.itertuples(index=False)]
    assert [r[1:] for r in seen] == sorted(r[1:] for r in rows)
    assert sorted(seen) == sorted(rows)


def test_merge_holds_little(monkeypatch):
    """A step of the merge passes on at most one frame of each run."""
    monkeypatch.setattr(gate, "MERGE_ROWS", 50)
    rows = [("a", n * 7919 % 20_011, n) for n in range(20_000)]
    sizes = [len(f) for f in gate.in_order(frames(rows, 100), 1_000)]
    assert sum(sizes) == 20_000 and max(sizes) <= 20 * 50 + 1_000


def test_frames_arrive_one_batch_at_a_time():
    """Frames are drawn one by one and the state keeps the last sha. Runs of 20 rows lie on disk."""
    drawn = []

    def source():
        for n, frame in enumerate(frames([("a", n, n) for n in range(100)], 10)):
            drawn.append(n)
            yield frame

    class State:
        exists, get = False, None

        def update(self, value):
            self.get = value

    state = State()
    found = gate._changed(20)(("r",), source(), state)
    assert drawn == []
    assert [tie for f in found for tie in f["tie"]] == [0]
    assert drawn == [*range(10)] and state.get == ("a",)


def test_hot_repository_and_missing_places(spark, tmp_path):
    """One repository sends 20,000 of 21,000 arrivals in any order; its task holds 1,000 at a time."""
    random.seed(3)
    rows = [("hot" if n % 21 else f"c{n % 5}", random.choice("ab"), random.choice([None, *range(9_000)]), n) for n in range(21_000)]
    rows += [("hot", None, 5, 30_000), ("quiet", "a", None, None), (None, "a", 1, 1), (None, "a", 2, 2), ("", "b", 1, 1)]
    last, expected = {}, set()
    for repo, sha, _, tie in sorted((r for r in rows if r[1]), key=lambda r: (r[2] is not None, r[2] or 0, r[3] or -1)):
        if repo not in last or last[repo] != sha:
            expected.add((repo, sha, tie))
        last[repo] = sha
    random.shuffle(rows)
    sent = spark.createDataFrame(rows, "repo string, sha string, sec long, id long")
    sent.repartition(5).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(sent.schema).parquet(str(tmp_path / "in")).select(
        "repo", "sha", gate.sequence(F.timestamp_seconds("sec"), F.col("id")).alias("seq"))
    provider = spark.conf.get(gate.PROVIDER)
    for _ in range(2):  # the second start finds nothing new
        query = gate.stream_change_gate(arriving, str(tmp_path / "out"), str(tmp_path / "state"), held_rows=1_000)
        query.awaitTermination()
        seen = gate.read_changes(spark, str(tmp_path / "out")).select("repo", "sha", "tie").collect()
        assert len(seen) == len(expected) and {tuple(r) for r in seen} == expected
    assert spark.conf.get(gate.PROVIDER) == provider
