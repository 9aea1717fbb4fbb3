"""Compaction of a stored message table: bounded files, same rows, safe stops."""

import pytest
from pyspark.sql import functions as F

from msgpulse.plans.inputs import event_messages
from msgpulse.schema import MESSAGE_COLUMNS
from msgpulse.session import scratch_path
from msgpulse.sources import compaction, sinks


def rows_of(spark, path):
    return sorted(tuple(r) for r in sinks.read_messages(spark, path).select(*MESSAGE_COLUMNS).collect())


@pytest.fixture(scope="module")
def filled(spark, sf):
    """A table after 50 inserts, each a fiftieth of the messages (and a repeat of an earlier one)."""
    path = scratch_path(spark, "compact")
    messages = event_messages(spark, sf)
    part = F.abs(F.hash("id")) % 50
    for k in range(50):
        sinks.insert_if_absent(messages.where((part == k) | (part == max(0, k - 1))), path)
    return path


def test_fifty_inserts_then_compaction_bound_the_files(spark, filled):
    before = rows_of(spark, filled)
    counts = compaction.files_per_folder(spark, filled)
    assert max(counts.values()) > 10
    done = compaction.compact(spark, filled)
    after = compaction.files_per_folder(spark, filled)
    assert done["groups"] and max(after.values()) == 1 and set(after) == set(counts)
    assert rows_of(spark, filled) == before
    assert compaction.compact(spark, filled)["files"] == 0  # nothing left to do


@pytest.mark.parametrize("stop", ["plan", "stage", "commit"])
def test_a_stop_between_steps_loses_and_doubles_nothing(spark, sf, stop):
    path = scratch_path(spark, "compact-stop")
    messages = event_messages(spark, sf)
    part = F.abs(F.hash("id")) % 6
    for k in range(6):
        sinks.insert_if_absent(messages.where(part == k), path)
    before, files = rows_of(spark, path), compaction.files_per_folder(spark, path)
    stopped = compaction.compact(spark, path, stop_after=stop)
    assert stopped["stopped"] == stop
    if stop != "commit":
        assert rows_of(spark, path) == before and compaction.files_per_folder(spark, path) == files
    finished = compaction.recover(spark, path)
    assert bool(finished) == (stop == "commit")
    assert rows_of(spark, path) == before
    # The next insert recovers first as well, and adds nothing that is stored.
    assert sinks.insert_if_absent(messages, path)["inserted"] == 0
    assert rows_of(spark, path) == before


def test_a_stop_inside_the_last_step_is_finished(spark, sf):
    path = scratch_path(spark, "compact-apply")
    messages = event_messages(spark, sf)
    part = F.abs(F.hash("id")) % 4
    for k in range(4):
        sinks.insert_if_absent(messages.where(part == k), path)
    before = rows_of(spark, path)
    compaction.compact(spark, path, stop_after="commit")
    # Half of step 4 by hand: some sources gone, nothing moved yet.
    fs, _ = compaction._fs(spark, path)
    planned = compaction.data_files(spark, path)
    for found in list(planned.values())[::2]:
        fs.delete(compaction._path(spark, found[0][0]), False)
    compaction.recover(spark, path)
    assert rows_of(spark, path) == before


def test_rounds_are_bounded_and_cover_everything(spark, sf):
    path = scratch_path(spark, "compact-rounds")
    messages = event_messages(spark, sf)
    part = F.abs(F.hash("id")) % 8
    for k in range(8):
        sinks.insert_if_absent(messages.where(part == k), path)
    before = rows_of(spark, path)
    done = compaction.compact(spark, path, max_files=3)
    assert done["rounds"] > 1
    assert max(compaction.files_per_folder(spark, path).values()) <= 3
    assert rows_of(spark, path) == before


def test_plan_groups_by_size_and_leaves_single_files():
    files = {"t=A": [("a1", 10), ("a2", 10), ("a3", 10), ("big", 1000)], "t=B": [("b1", 5)]}
    got = compaction.plan(files, target_bytes=20, small_bytes=100)
    assert got == [(0, "t=A", "a1", 10), (0, "t=A", "a2", 10)]
    assert compaction.plan({}, 20, 100) == []
