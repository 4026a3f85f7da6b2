"""The plans Spark makes: what is pruned, pushed, broadcast and shuffled."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import functions as F

from wayside.operators import dedup
from wayside.operators.dedup import first_of_key, later_copies
from wayside.operators.filters import in_local_days, in_utc_days, newest
from wayside.operators.sizing import fits_broadcast, lookup_join
from wayside.operators.taxi import areas_of_names, taxi_hour
from wayside.operators.traffic import heavy_hour, passage_hour
from wayside.sources import passages as stored_passages
from wayside.sources.passages import append_passages, read_passages, ready_to_add


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "200")
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, make_passages, folder):
    rows = make_passages(*[{"passage_at": datetime(2024, 3, d, 23, 30)} for d in range(10, 16)])
    append_passages(rows, folder + "/t")
    return read_passages(spark, folder + "/t")


def test_day_windows_prune_folders_and_reach_the_scan(spark, make_passages, folder):
    table = stored(spark, make_passages, folder)
    utc = in_utc_days(table, date(2024, 3, 12))
    assert [r.passage_at.day for r in utc.collect()] == [12]
    assert re.search(r"PartitionFilters: \[.*passage_date.*2024-03-12.*2024-03-12", plan(utc))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(passage_at", plan(utc))
    local = in_local_days(table, date(2024, 3, 12))
    assert [r.passage_at.day for r in local.collect()] == [11]
    assert re.search(r"PartitionFilters: \[.*2024-03-11.*2024-03-12", plan(local))


def test_hourly_count_reads_its_columns_only_and_shuffles_once(spark, make_passages, folder):
    text = plan(passage_hour(in_utc_days(stored(spark, make_passages, folder), date(2024, 3, 12))))
    assert text.count("Exchange hashpartitioning") == 1
    (scan,) = re.findall(r"FileScan parquet \[([^\]]*)\]", text)
    assert "voertuig_soort" in scan and "kenteken_hash" not in scan and "merk" not in scan


def test_camera_join(spark, make_passages, make_cameras, folder):
    table = in_local_days(stored(spark, make_passages, folder), date(2024, 3, 12))
    small = plan(heavy_hour(table, make_cameras({})))
    assert "BroadcastHashJoin" in small and small.count("Exchange hashpartitioning") == 1
    large = plan(heavy_hour(table, make_cameras({}), 0))
    assert "_salt" in large
    # counted before the join: a grouping lies below the salted shuffle
    assert large.count("HashAggregate") >= 4


def test_a_large_lookup_in_a_small_file_is_not_broadcast(spark, folder):
    """Spark would go by the size of the file, before the copies for the buckets."""
    spark.range(10).select("id", (F.col("id") * 2).alias("v")).write.parquet(f"{folder}/lookup")
    lookup = spark.read.parquet(f"{folder}/lookup")
    for how, rows in (("inner", 10), ("left", 20)):
        joined = lookup_join(spark.range(20), lookup, ["id"], how, ["id"], 0)
        text = plan(joined)
        assert "SortMergeJoin" in text and "Broadcast" not in text
        assert joined.count() == rows


def test_a_broadcast_side_is_bounded_in_rows_and_bytes(spark):
    wide = spark.range(10).select("id", F.repeat(F.lit("é"), 1_000).alias("t"), F.array("id").alias("a.b"))
    # 2,000 bytes of text, 4 of the number and the list, 32 of the row and 24 of values
    assert fits_broadcast(wide, max_bytes=20_600) and not fits_broadcast(wide, max_bytes=20_599)
    assert fits_broadcast(wide, 10) and not fits_broadcast(wide, 9)
    nulls = wide.select(F.lit(None).cast("string").alias("t"))
    assert fits_broadcast(nulls, max_bytes=400) and not fits_broadcast(nulls, max_bytes=399)
    assert fits_broadcast(wide.limit(0), 0, 0)


def test_no_pairwise_join(spark, make_passages, make_areas):
    names = make_passages({}).select("camera_naam").distinct()
    text = plan(areas_of_names(names, make_areas(("1", "t", "g", "ANPR_0"))))
    assert "NestedLoop" not in text and "Cartesian" not in text
    taxi = plan(taxi_hour(make_passages({}), make_areas(("1", "t", "g", "ANPR_0"))))
    assert "NestedLoop" not in taxi and "Cartesian" not in taxi


def test_copies_are_combined_before_the_shuffle(make_passages):
    same = {"passage_id": "00000000-0000-0000-0000-000000000009"}
    text = plan(first_of_key(make_passages(same, same), max_repeated=0))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_min" in text.split("Exchange hashpartitioning")[1]
    assert "Window" not in text


def test_page_is_a_top_k(make_passages):
    assert "TakeOrderedAndProject" in plan(newest(make_passages({}, {})))


def test_rows_of_single_keys_are_not_shuffled(spark, make_passages):
    """Keys are counted on three columns; only copies are grouped in full."""
    same = {"passage_id": "00000000-0000-0000-0000-000000000009"}
    text = plan(first_of_key(make_passages({}, same, same)))
    assert "LeftAnti" in text and "BroadcastHashJoin" in text
    assert text.count("Exchange hashpartitioning") == 1
    before = text.split("Exchange hashpartitioning")[1]
    assert "partial_min" in before and "LeftSemi" in before


def test_many_later_copies_are_shuffled_once(spark, make_passages, monkeypatch):
    """By key; only rows of very frequent keys are combined first.  Both give the same."""
    names = ["00000000-0000-0000-0000-00000000000" + str(n % 4) for n in range(24)]
    hot = [{"passage_id": names[0], "volgnummer": 7 + n % 2, "lengte": n % 3} for n in range(40)]
    df = make_passages(*[{"passage_id": name, "breedte": n % 5} for n, name in enumerate(names)], *hot)
    df = df.withColumn("volgnummer", F.nullif("volgnummer", F.lit(8)))
    text = plan(later_copies(df, max_repeated=0))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
    combined = sorted(map(str, later_copies(df).collect()))
    assert sorted(map(str, later_copies(df, max_repeated=0).collect())) == combined
    monkeypatch.setattr(dedup, "HOT_ROWS", 10)
    found = later_copies(df, max_repeated=0)
    assert "partial_min" in plan(found) and "Window" in plan(found)
    assert sorted(map(str, found.collect())) == combined


def test_missing_days_prune_folders(spark, make_passages, folder):
    from wayside.operators.quality import missing_days

    table = stored(spark, make_passages, folder)
    found = missing_days(table, date(2024, 3, 12), date(2024, 3, 20))
    assert found.count() == 5
    assert re.search(r"PartitionFilters: \[.*passage_date.*2024-03-12.*2024-03-20", plan(found))


def test_a_large_batch_is_written_by_day_without_a_shuffle(spark, make_passages, folder, monkeypatch):
    """Its tasks have many rows of each day; a small batch's rows are gathered by day."""
    times = [{"passage_at": datetime(2024, 3, 10 + n % 2, n % 24), "volgnummer": n} for n in range(40)]
    make_passages(*times).coalesce(1).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    assert "REBALANCE" in plan(ready_to_add(rows))
    monkeypatch.setattr(stored_passages, "OWN_FILE_ROWS", 20)
    assert "Exchange" not in plan(ready_to_add(rows))
    assert "REBALANCE" in plan(ready_to_add(rows, gather=True))
    monkeypatch.setattr(stored_passages, "OWN_TASK_ROWS", 39)
    assert "REBALANCE" in plan(ready_to_add(rows))
    monkeypatch.setattr(stored_passages, "OWN_TASK_ROWS", 40)
    append_passages(rows, folder + "/t")
    table = read_passages(spark, folder + "/t")
    assert sorted((r.volgnummer, r.passage_date.day) for r in table.collect()) == [
        (n, 10 + n % 2) for n in range(40)
    ]
    assert "REBALANCE" in plan(ready_to_add(rows.filter("volgnummer < 0")))


def test_large_files_are_read_in_smaller_parts_while_they_are_added(
    spark, make_passages, folder, monkeypatch
):
    """No task sorts more rows than it may, and none is shuffled; the setting comes back."""
    times = [{"passage_at": datetime(2024, 3, 10, n % 24), "volgnummer": n} for n in range(160)]
    make_passages(*times).repartition(16).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    setting = "spark.sql.files.maxPartitionBytes"
    given = spark.conf.get(setting)
    monkeypatch.setattr(stored_passages, "OWN_FILE_ROWS", 1)
    with stored_passages.adding(rows) as whole:
        parts = whole.select(F.spark_partition_id()).distinct().count()
    monkeypatch.setattr(stored_passages, "OWN_SORT_ROWS", 1)
    with stored_passages.adding(rows) as smaller:
        assert "Exchange" not in plan(smaller)
        assert smaller.select(F.spark_partition_id()).distinct().count() == 16 > parts
        assert smaller.count() == 160
    assert spark.conf.get(setting) == given


def test_equal_passages_are_one_before_they_meet_their_areas(spark, make_passages, make_areas):
    from wayside.operators.taxi import with_areas

    rows = make_passages(*[{"camera_naam": "cam-1"}] * 3).select("camera_naam")
    areas = make_areas(*[{"id": str(n), "gebied": f"G{n}", "camera_id": "cam"} for n in range(2)])
    assert with_areas(rows, areas).count() == 6
    once = with_areas(rows, areas, 0, distinct=True)
    assert sorted(r.gebied for r in once.collect()) == ["G0", "G1"]


def test_a_refresh_of_many_rows_is_written_without_gathering(
    spark, make_passages, folder, monkeypatch
):
    from wayside.plans import refresh as plans

    times = [{"passage_at": datetime(2024, 3, 10 + n % 3, n % 24)} for n in range(40)]
    rows, span = make_passages(*times), (date(2024, 3, 13), date(2024, 3, 10))
    plans.refresh("passage_hour", rows, {}, f"{folder}/gathered", *span)
    monkeypatch.setattr(stored_passages, "OWN_FILE_ROWS", 0)
    monkeypatch.setattr(plans, "laid_out", None)
    done = plans.refresh("passage_hour", rows, {}, f"{folder}/own", *span)
    assert len(done.written) == 3
    tables = [plans.read_table(spark, f"{folder}/{n}", "passage_hour") for n in ("gathered", "own")]
    assert sorted(map(str, tables[0].collect())) == sorted(map(str, tables[1].collect()))
