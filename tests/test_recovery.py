"""Batches under labels, leases of killed runs, generations and the log."""

from __future__ import annotations

import json
import threading
import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_ingest import FLAT, NOW
from wayside.plans import ingest, rewrite
from wayside.plans.counts import read_counts, update_counts, window_counts
from wayside.plans.ingest import ingest_batch, store_new
from wayside.schemas import NATURAL_KEY
from wayside.sources import batches, key_index
from wayside.sources.files import (
    names_in,
    path_exists,
    read_content,
    remove,
    write_new,
    write_over,
)
from wayside.sources.generations import current_folder, fresh_folder, retire, switch
from wayside.sources.lease import Lease, LeaseLost, log_folder, only_writer, take_lease
from wayside.sources.passages import append_passages, read_passages

DAY = datetime(2024, 3, 12, 10)


def payload_lines(spark, *payloads):
    return spark.createDataFrame([(json.dumps(p),) for p in payloads], "value string")


def keys(df):
    return sorted(tuple(r) for r in df.select(*NATURAL_KEY).collect())


# ------------------------------------------------------------------- small files


def test_files_are_made_once_and_replaced(spark, folder):
    path = folder + "/a/b.json"
    assert read_content(spark, path) is None
    assert write_new(spark, path, {"n": 1}) and not write_new(spark, path, {"n": 2})
    assert read_content(spark, path) == {"n": 1}
    write_over(spark, path, {"n": "é"})
    assert read_content(spark, path) == {"n": "é"}
    assert names_in(spark, folder + "/a") == ["b.json"] and names_in(spark, folder + "/c") == []


# ------------------------------------------------------------------------- lease


def test_two_live_writers_collide(spark, folder):
    table = folder + "/t"
    with only_writer(spark, table) as first:
        with pytest.raises(RuntimeError, match="another run"):
            take_lease(spark, table)
        started = time.time()
        with pytest.raises(RuntimeError, match="another run"):
            with only_writer(spark, table, wait=0.5):
                pass
        assert time.time() - started >= 0.5
    with only_writer(spark, table) as second:
        assert second.number == first.number + 1


def test_a_lease_is_renewed_while_its_run_lives(spark, folder):
    with only_writer(spark, folder + "/t", lasts=0.9) as lease:
        time.sleep(2)
        lease.check()


def test_a_killed_run_is_followed_without_a_hand(spark, make_passages, folder):
    table = folder + "/passages"
    killed = take_lease(spark, table, lasts=1.5)  # never renewed, never released
    with pytest.raises(RuntimeError, match="another run"):
        store_new(make_passages({}), table)
    store_new(make_passages({}), table, wait=10)
    assert read_passages(spark, table).count() == 1
    with pytest.raises(LeaseLost):
        killed.check()
    with pytest.raises(LeaseLost):  # it wakes up too late to write
        batches.add_batch(killed, make_passages({"volgnummer": 9}))
    assert read_passages(spark, table).count() == 1


def test_a_lease_file_without_content_runs_out_too(spark, folder):
    table = folder + "/t"
    path = Lease(spark, table, 1, 1.0, 0).path
    write_new(spark, path, {})
    open(path.removeprefix("file:"), "w").close()
    with pytest.raises(RuntimeError, match="just began"):
        take_lease(spark, table, lasts=60)
    time.sleep(1.1)
    assert take_lease(spark, table, lasts=1).number == 2


def test_one_of_many_gets_the_lease(spark, folder):
    got = []

    def run():
        try:
            got.append(take_lease(spark, folder + "/t").number)
        except RuntimeError:
            pass

    threads = [threading.Thread(target=run) for _ in range(6)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert len(got) == len(set(got)) >= 1


# ------------------------------------------------------------------------ labels


def test_a_label_stands_for_one_content(spark, folder):
    places = [f"{folder}/{name}" for name in ("passages", "invalid", "duplicates")]
    broken = {**FLAT, "kentekenLand": "too long"}
    one = payload_lines(spark, FLAT, broken)
    other = payload_lines(spark, {**FLAT, "volgnummer": 7}, {**broken, "volgnummer": 8})
    assert ingest_batch({"v1": one}, *places, batch="a", now=NOW)
    assert not ingest_batch({"v1": one.repartition(3)}, *places, batch="a", now=NOW)
    with pytest.raises(batches.LabelTaken):
        ingest_batch({"v1": other}, *places, batch="a", now=NOW)
    with pytest.raises(batches.LabelTaken):  # the same lines as another version
        ingest_batch({"v2": one}, *places, batch="a", now=NOW)
    assert read_passages(spark, places[0]).count() == 1
    assert ingest_batch({"v1": other}, *places, batch="b/1", now=NOW)
    assert read_passages(spark, places[0]).count() == 2
    rejects = spark.read.parquet(places[1])
    assert rejects.count() == 2  # both runs' rejects are there


def test_a_label_is_taken_before_rejects_are_written(spark, folder, monkeypatch):
    places = [f"{folder}/{name}" for name in ("passages", "invalid", "duplicates")]
    monkeypatch.setattr("wayside.plans.ingest.add_batch", _fail)
    with pytest.raises(OSError):
        ingest_batch({"v1": payload_lines(spark, FLAT)}, *places, batch="a", now=NOW)
    monkeypatch.undo()
    with pytest.raises(batches.LabelTaken):
        ingest_batch({"v1": payload_lines(spark, {**FLAT, "volgnummer": 7})}, *places, batch="a", now=NOW)
    assert ingest_batch({"v1": payload_lines(spark, FLAT)}, *places, batch="a", now=NOW)
    assert read_passages(spark, places[0]).count() == 1


def test_a_batch_is_kept_in_files_without_the_text_of_its_records(spark, folder, monkeypatch):
    places = [f"{folder}/{name}" for name in ("passages", "invalid", "duplicates")]
    kept, staged = [], ingest.staged

    def watched(df, label):
        kept.append((df, label))
        return staged(df, label)

    monkeypatch.setattr(ingest, "staged", watched)
    lines = payload_lines(spark, FLAT, {**FLAT, "volgnummer": 7}, {**FLAT, "kentekenLand": "too long"})
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert ingest_batch({"v1": lines}, *places, batch="a", now=NOW)
    assert [label for _, label in kept] == ["validated", "marked"]
    validated = kept[0][0]
    assert validated.count() == 3 and validated.filter("payload is not null").count() == 1
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= cached
    assert spark.read.parquet(places[1]).filter("payload like '%too long%'").count() == 1
    assert read_passages(spark, places[0]).count() == 2


def _fail(*_):
    raise OSError("killed")


# --------------------------------------------------------------------------- log


def spread(make_passages, first, n):
    return make_passages(
        *[
            {
                "passage_id": f"00000000-0000-0000-0000-{first + i:012d}",
                "passage_at": DAY + timedelta(hours=17 * (first + i)),
                "created_at": DAY + timedelta(hours=first + i),
                "camera_naam": f"c{i % 3}",
            }
            for i in range(n)
        ]
    )


def check_log(spark, table):
    rows, log = read_passages(spark, table), batches.read_log(spark, table)
    want = {r[0]: r[1] for r in rows.groupBy("passage_date").count().collect()}
    span = rows.agg(F.max("created_at"), F.min("passage_at"), F.max("passage_at")).first()
    assert log.days == want and log.rows == rows.count()
    assert (log.newest, log.first, log.last) == tuple(span)


def test_log_agrees_with_a_scan(spark, make_passages, folder, monkeypatch):
    table = folder + "/passages"
    append_passages(spread(make_passages, 0, 5), table)  # rows from before there was a log
    monkeypatch.setattr(batches, "LOOSE", 3)
    for n in range(1, 8):
        store_new(spread(make_passages, 5 * n - 1, 6), table)  # the first is there already
        check_log(spark, table)
    log = batches.read_log(spark, table)
    assert log.rows == 40 and 0 < len(log.loose) < 4 and log.folded > 3


def test_a_batch_killed_between_its_files_is_finished(spark, make_passages, folder, monkeypatch):
    table, counts = folder + "/passages", folder + "/counts"
    store_new(spread(make_passages, 0, 4), table)
    update_counts(spark, table, counts)
    rows, moved = spread(make_passages, 4, 6), []

    def move_two(spark, source, target):
        if len(moved) == 2:
            raise OSError("killed")
        moved.append(target)
        move(spark, source, target)

    move = batches.move
    monkeypatch.setattr(batches, "move", move_two)
    with pytest.raises(OSError):
        store_new(rows, table, "label")
    monkeypatch.undo()
    assert 4 < read_passages(spark, table).count() < 10
    assert store_new(rows, table, "label") and not store_new(rows, table, "label")
    assert read_passages(spark, table).count() == 10
    check_log(spark, table)
    assert names_in(spark, log_folder(table) + "/staging") == []
    update_counts(spark, table, counts)
    same_counts(spark, table, counts)


# ------------------------------------------------------------------- generations


def test_readers_keep_their_generation(spark, make_passages, folder):
    table = folder + "/passages"
    append_passages(make_passages({}, {}), table)
    old = read_passages(spark, table)
    with only_writer(spark, table) as lease:
        target = fresh_folder(table)
        append_passages(make_passages({}), target)
        switch(lease, target)
        assert retire(lease) == []
        assert old.count() == 2 and read_passages(spark, table).count() == 1
        assert retire(lease, grace=0) == ["passages"]
    assert not path_exists(spark, table)
    assert read_passages(spark.newSession(), table).count() == 1
    assert current_folder(spark, table) == target


def heavy(make_passages, *numbers):
    return make_passages(
        *[
            {
                "passage_id": f"00000000-0000-0000-0000-{n:012d}",
                "passage_at": DAY + timedelta(days=n),
                "toegestane_maximum_massa_voertuig": 2000,
                "merk": "m",
            }
            for n in numbers
        ]
    )


def test_masking_takes_in_what_came_meanwhile(spark, make_passages, folder):
    table, counts = folder + "/passages", folder + "/counts"
    append_passages(heavy(make_passages, 0, 1), table)
    store_new(heavy(make_passages, 2), table)
    update_counts(spark, table, counts)
    masking = rewrite.begin_masking(spark, table)
    store_new(heavy(make_passages, 2, 3), table)  # a day that is masked already, and a new one
    store_new(heavy(make_passages, 4), table)
    unmasked = {r.merk for r in read_passages(spark, table).collect()}
    masking.finish()
    rows = read_passages(spark, table)
    assert unmasked == {"m"} and {r.merk for r in rows.collect()} == {None}
    assert {r.toegestane_maximum_massa_voertuig for r in rows.collect()} == {1500}
    assert [k[0][-1] for k in keys(rows)] == list("01234")
    check_log(spark, table)
    store_new(heavy(make_passages, 5), table)
    assert read_passages(spark, table).count() == 6
    update_counts(spark, table, counts)  # the files have lost their numbers: counted afresh
    same_counts(spark, table, counts)


def test_masking_of_a_replaced_table_stops(spark, make_passages, folder):
    table = folder + "/passages"
    append_passages(heavy(make_passages, 0), table)
    late = rewrite.begin_masking(spark, table)
    rewrite.mask_table(spark, table)
    with pytest.raises(RuntimeError, match="was replaced"):
        late.finish()
    assert read_passages(spark, table).count() == 1


# ------------------------------------------------------------------------ counts


def same_counts(spark, table, counts):
    want = window_counts(read_passages(spark, table)).collect()
    assert sorted(map(tuple, read_counts(spark, counts).collect())) == sorted(map(tuple, want))


def test_counts_follow_the_batches(spark, make_passages, folder, monkeypatch):
    table, counts = folder + "/passages", folder + "/counts"
    assert not update_counts(spark, table, counts)
    monkeypatch.setattr(batches, "LOOSE", 4)
    for n in range(10):
        store_new(spread(make_passages, 10 * (n % 7), 11), table)
        if n not in (3, 4, 5, 6, 7):  # it lags behind a fold
            assert update_counts(spark, table, counts)
            same_counts(spark, table, counts)
    assert not update_counts(spark, table, counts)
    state = read_content(spark, log_folder(counts) + "/parts.json")
    assert len(state["parts"]) <= 3
    with pytest.raises(ValueError, match="by hour"):
        update_counts(spark, table, counts, "minute")


def test_a_small_batch_reads_its_own_files_only(spark, make_passages, folder):
    table = folder + "/passages"
    store_new(make_passages(*[{"passage_at": DAY} for _ in range(50)]), table)
    through = batches.read_log(spark, table).through
    few = [{"passage_id": f"10000000-0000-0000-0000-{n:012d}", "passage_at": DAY} for n in range(3)]
    store_new(make_passages(*few), table)
    log = batches.read_log(spark, table)
    (days,) = [days for number, days in log.loose if number > through]
    assert days == (date(2024, 3, 12),)
    rows = batches.rows_of(spark, table, through, log.through, list(days))
    assert rows.count() == 3
    read = rows.select("_metadata.file_name").distinct().collect()
    assert len(read) == 1
    plan = rows._jdf.queryExecution().executedPlan()
    rows._jdf.collectToPython()
    assert "file_name" in plan.toString()


def test_counts_of_empty_batches(spark, make_passages, folder):
    table, counts = folder + "/passages", folder + "/counts"
    store_new(make_passages({}).limit(0), table)
    assert update_counts(spark, table, counts) and read_counts(spark, counts).count() == 0
    store_new(make_passages({}).limit(0), table)
    assert update_counts(spark, table, counts)
    store_new(make_passages({}), table)
    assert update_counts(spark, table, counts)
    same_counts(spark, table, counts)


def test_a_killed_count_is_done_again(spark, make_passages, folder, monkeypatch):
    table, counts = folder + "/passages", folder + "/counts"
    store_new(spread(make_passages, 0, 9), table)
    monkeypatch.setattr("wayside.plans.counts.write_over", _fail)
    with pytest.raises(OSError):
        update_counts(spark, table, counts)
    monkeypatch.undo()
    assert update_counts(spark, table, counts)
    same_counts(spark, table, counts)


# -------------------------------------------------------------------- index, files


def opened(monkeypatch):
    """The days of history that are opened."""
    days = []

    def watched(spark, table, chosen, real=ingest.read_days):
        days.extend(chosen)
        return real(spark, table, chosen)

    monkeypatch.setattr(ingest, "read_days", watched)
    monkeypatch.setattr(ingest, "same_days", _fail)
    return days


def test_new_keys_open_no_history(spark, make_passages, folder, monkeypatch):
    table = folder + "/passages"
    append_passages(spread(make_passages, 0, 6), table)  # indexed with the first batch
    store_new(spread(make_passages, 6, 6), table)
    days = opened(monkeypatch)
    same_time = {"passage_at": DAY, "passage_id": "90000000-0000-0000-0000-000000000000"}
    assert store_new(make_passages(same_time), table) and days == []
    store_new(spread(make_passages, 11, 3), table)  # the first is stored
    assert days == [(DAY + timedelta(hours=17 * 11)).date()]
    del days[:]
    store_new(spread(make_passages, 0, 1), table)  # from before there was an index
    assert days == [DAY.date()]
    assert read_passages(spark, table).count() == 15
    check_log(spark, table)


def test_answers_are_the_same_without_the_index(spark, make_passages, folder):
    rows = []
    for name in ("with", "without"):
        table = f"{folder}/{name}"
        for first in (0, 3, 4, 12, 2):
            store_new(spread(make_passages, first, 5), table)
            if name == "without":
                remove(spark, log_folder(table) + "/keys")
        rows.append(keys(read_passages(spark, table)))
        assert key_index.is_complete(spark, table) == (name == "with")
    assert rows[0] == rows[1] and len(rows[0]) == 14
    with only_writer(spark, table) as lease:
        key_index.build_index(lease, read_passages(spark, table))
    stored = spark.read.schema(key_index.KEYS).parquet(log_folder(table) + "/keys")
    assert stored.count() == 14
    assert key_index.days_to_ask(spark, table, spread(make_passages, 90, 3)) == []


def test_a_batch_killed_after_its_keys_is_stored_later(spark, make_passages, folder, monkeypatch):
    table, rows = folder + "/passages", spread(make_passages, 0, 4)
    monkeypatch.setattr(batches, "move", _fail)
    with pytest.raises(OSError):
        store_new(rows, table, "label")
    monkeypatch.undo()
    assert store_new(rows, table, "label")
    assert read_passages(spark, table).count() == 4
    check_log(spark, table)


def test_small_files_are_packed(spark, make_passages, folder):
    table, counts = folder + "/passages", folder + "/counts"
    for n in range(12):
        row = {"passage_id": f"{n:08d}-0000-0000-0000-000000000000", "passage_at": DAY}
        store_new(make_passages(row), table)
    before = read_passages(spark, table)
    packing = rewrite.begin_rewrite(spark, table, rewrite.packed)
    store_new(make_passages({"passage_at": DAY + timedelta(days=1)}), table)
    assert read_passages(spark, table).count() == 13
    packing.finish()
    after = read_passages(spark, table)
    assert len(before.inputFiles()) == 12 and len(after.inputFiles()) == 2
    assert before.count() == 12 and after.count() == 13
    check_log(spark, table)
    update_counts(spark, table, counts)
    same_counts(spark, table, counts)
    store_new(spread(make_passages, 0, 3), table)  # the first is stored
    assert read_passages(spark, table).count() == 15
