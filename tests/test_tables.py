from __future__ import annotations

import csv
import glob
import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayside.operators.export import camera_delivery, hourly_totals
from wayside.operators.traffic import passage_hour
from wayside.plans.refresh import JOBS, aggregate_days, refresh, replace_days, run_days
from wayside.plans.rewrite import rewrite_history
from wayside.sources.passages import append_passages, read_passages
from wayside.sources.reference_data import (
    BrokenTable,
    load_cameras,
    load_taxi_areas,
    read_helper,
    replace_table,
)
from wayside.sources.sinks import write_delivery_csv, write_hourly_csv

DAY = date(2024, 3, 12)


def on_days(make_passages, counts):
    return make_passages(
        *[
            {"passage_at": datetime(2024, 3, day, 10)}
            for day, n in counts.items()
            for _ in range(n)
        ]
    )


def totals(spark, path):
    df = spark.read.parquet(path).groupBy("date").agg(F.sum("count").alias("n"))
    return {r["date"].day: r["n"] for r in df.collect()}


def test_refresh_replaces_exactly_its_days(spark, make_passages, folder):
    path = folder + "/hours"
    rows = on_days(make_passages, {10: 1, 11: 2, 12: 3})
    done = refresh("passage_hour", rows, {}, path, date(2024, 3, 13), date(2024, 3, 10))
    assert done.written == [date(2024, 3, d) for d in (10, 11, 12)] and done.cleared == []
    for _ in range(2):  # a rerun changes nothing
        refresh("passage_hour", rows, {}, path, date(2024, 3, 13))
        assert totals(spark, path) == {10: 1, 11: 2, 12: 3}
    more = on_days(make_passages, {11: 50, 12: 7})
    done = refresh("passage_hour", more, {}, path, date(2024, 3, 13))
    assert (done.written, done.rows) == ([DAY], 1)
    assert totals(spark, path) == {10: 1, 11: 2, 12: 7}


def test_refresh_clears_a_day_that_came_out_empty(spark, make_passages, folder):
    path = folder + "/hours"
    rows = on_days(make_passages, {11: 2, 12: 3})
    refresh("passage_hour", rows, {}, path, date(2024, 3, 13), date(2024, 3, 11))
    done = refresh("passage_hour", rows.limit(0), {}, path, date(2024, 3, 13))
    assert (done.written, done.cleared) == ([], [DAY])
    assert totals(spark, path) == {11: 2}
    done = refresh("passage_hour", rows.limit(0), {}, path, date(2024, 3, 13))
    assert done.cleared == []
    refresh("passage_hour", rows, {}, path, date(2024, 3, 13))
    assert totals(spark, path) == {11: 2, 12: 3}


def test_first_refresh_without_rows(spark, make_passages, folder):
    done = refresh("passage_hour", make_passages({}).limit(0), {}, folder + "/t", DAY)
    assert (done.written, done.cleared, done.rows) == ([], [], 0)


def test_rows_outside_the_run_are_an_error(spark, make_passages, folder):
    hours = passage_hour(on_days(make_passages, {11: 1, 12: 1}))
    with pytest.raises(ValueError):
        replace_days(hours, folder + "/t", "date", DAY, DAY)


def test_run_days():
    today = date(2024, 3, 13)
    assert run_days(JOBS["passage_hour"], today) == (DAY, DAY)
    assert run_days(JOBS["heavy_hour"], today) == (DAY, DAY)
    assert run_days(JOBS["taxi_hour"], today) == (date(2024, 3, 10), DAY)
    assert run_days(JOBS["igor_hour"], today, date(2024, 1, 1)) == (date(2024, 1, 1), DAY)


def test_future_backfill_does_nothing(make_passages, folder):
    assert refresh("passage_hour", make_passages({}), {}, folder + "/t", DAY, DAY) is None


def test_all_jobs_refresh(spark, make_passages, make_cameras, make_areas, folder):
    rows = make_passages({"taxi_indicator": True, "electric": 1})
    lookups = {"cameras": make_cameras({}), "areas": make_areas(("1", "t", "g", "ANPR"))}
    for name in JOBS:
        done = refresh(name, rows, lookups, f"{folder}/{name}", date(2024, 3, 13))
        assert done.written == [DAY], name


def test_local_day_job_takes_the_local_day(make_passages, make_cameras):
    rows = make_passages(
        {"passage_at": datetime(2024, 3, 11, 23, 30)}, {"passage_at": datetime(2024, 3, 12, 23, 30)}
    )
    lookups = {"cameras": make_cameras({})}
    (row,) = aggregate_days(JOBS["heavy_hour"], rows, lookups, DAY, DAY).collect()
    assert (row.passage_at_date, row.passage_at_hour) == (DAY, 0)


def test_history_rewrite_masks_every_day(spark, make_passages, folder):
    rows = make_passages(
        *[
            {"passage_at": datetime(2024, 3, d, 5), "toegestane_maximum_massa_voertuig": 2000,
             "merk": "m", "brandstoffen": [("Diesel", 1, None, None, None, None, None, None)]}
            for d in (10, 11, 12)
        ]
    )
    append_passages(rows, folder + "/old")
    masked = rewrite_history(spark, folder + "/old", folder + "/new")
    found = masked.collect()
    assert {r.toegestane_maximum_massa_voertuig for r in found} == {1500}
    assert {r.merk for r in found} == {None}
    assert {r.brandstoffen[0].brandstof for r in found} == {"Diesel"}
    assert sorted(r.passage_date.day for r in found) == [10, 11, 12]
    # one range again does not touch the other days
    rewrite_history(spark, folder + "/old", folder + "/new", DAY, DAY)
    assert read_passages(spark, folder + "/new").count() == 3
    with pytest.raises(ValueError):
        rewrite_history(spark, folder + "/old", folder + "/old/")


def test_camera_file(spark, folder):
    header = ("azimuth,camera_id,vma_linknr,camera_naam,rijrichting,rijrichting_correct,"
              "camera_kijkrichting,order_kaart,order_naam,cordon,richting,latitude,longitude,geom")
    lines = [
        header,
        '1.5,c1,v1,"Naam, met komma",1,JA,90,3,Punt,S100,in,52.3,4.8,g',
        ",,,n2,-1,nee,,,,,,52.3,,",
        ",,,n3,,,,,,,,,,",
    ]
    with open(folder + "/cameras.csv", "w") as out:
        out.write("\n".join(lines))
    one, two, three = load_cameras(spark, folder + "/cameras.csv").orderBy("camera_naam").collect()
    assert (one.camera_naam, one.rijrichting_correct) == ("Naam, met komma", True)
    assert (one.location.x, one.location.y, one.azimuth) == (52.3, 4.8, 1.5)
    assert (two.rijrichting_correct, two.location, two.cordon) == (False, None, None)
    assert (three.rijrichting_correct, three.rijrichting) == (None, None)


def test_area_file_replaces_the_table(spark, folder):
    def load(*lines):
        path = f"{folder}/areas-{len(lines)}.csv"
        with open(path, "w") as out:
            out.write("\n".join(["id,gebiedstype,gebied,camera_id", *lines]))
        return replace_table(load_taxi_areas(spark, path), "taxi_areas", folder + "/tables")

    def ids(session):
        return [r.id for r in read_helper(session, "taxi_areas", folder + "/tables").collect()]

    assert load("1,Stadsbreed,Stad,ANPR-1", "2,Stadsbreed,Stad,ANPR-3") == 2
    pinned = read_helper(spark, "taxi_areas", folder + "/tables")
    assert load("3,Stadsdelen,Oost,ANPR-2") == 1
    assert ids(spark) == ids(spark.newSession()) == ["3"]
    assert pinned.count() == 2  # a reader keeps to what it began with
    long = "x" * 256
    for broken in (
        ["4,Stadsdelen,Oost,ANPR-2"] * 2,
        ["4,Stadsdelen,Oost,", "5,a,b,c", "6,a,b,c"],
        [f"4,Stadsdelen,Oost,{long}"] + ["5,a,b,c"] * 3,
    ):
        with pytest.raises(BrokenTable):
            load(*broken)
    assert ids(spark) == ["3"]


HOURS = ("date date, year int, week int, hour int, camera_id string, camera_naam string,"
         " count bigint")


def hours(spark, start, days):
    out = []
    for n in range(days):
        day = start + timedelta(days=n)
        for hour in range(24):
            for camera in (1, 2, 3):
                row = (day, day.year, day.isocalendar()[1], hour, str(camera), f"Camera: {camera}", 4)
                out += [row, row]
    return spark.createDataFrame(out, HOURS)


def test_export_of_last_week(spark, folder):
    today = date(2019, 3, 13)
    monday = date(2019, 3, 4)
    table = hours(spark, monday - timedelta(days=7), 21)
    assert write_hourly_csv(hourly_totals(table, today=today), folder + "/csv") == 504
    lines = [
        line
        for path in sorted(glob.glob(folder + "/csv/part-*"))
        for line in open(path).read().splitlines()
    ]
    assert set(lines) & {"camera_id,camera_naam,bucket,sum"}
    data = [line.split(",") for line in lines if not line.startswith("camera_id,")]
    assert len(data) == 504 and {row[3] for row in data} == {"8"}
    assert [row[2] for row in data] == sorted(row[2] for row in data)
    assert data[0][2] == "2019-03-04 00:00:00" and data[-1][2] == "2019-03-10 23:00:00"


def test_export_filters_and_empty_export(spark, folder):
    table = hours(spark, date(2019, 3, 11), 1)
    assert hourly_totals(table, year=2019, week=11).count() == 72
    assert hourly_totals(table, year=2019).count() == 72
    assert write_hourly_csv(hourly_totals(table, year=2019, week=12), folder + "/csv") == 0
    assert "".join(open(p).read() for p in glob.glob(folder + "/csv/part-*")) == ""
    with pytest.raises(ValueError):
        hourly_totals(table)


def test_delivery_files(spark, make_passages, folder):
    rows = make_passages(
        {"camera_locatie": (4.5, 52.25), "automatisch_verwerkbaar": True, "straat": "",
         "brandstoffen": [("Diesel", 1, None, None, None, None, None, None)]},
        {"camera_id": "other"},
        {"passage_at": datetime(2024, 3, 13), "automatisch_verwerkbaar": None},
        {"passage_at": datetime(2024, 4, 1)},
    )
    found = camera_delivery(rows, ["cam-1"], date(2024, 3, 1), date(2024, 3, 31))
    write_delivery_csv(found, folder + "/out")
    text = {
        day: "".join(open(p).read() for p in glob.glob(f"{folder}/out/passage_date={day}/part-*"))
        for day in ("2024-03-12", "2024-03-13")
    }
    (fields,) = csv.reader(text["2024-03-12"].splitlines(), delimiter=";")
    assert len(fields) == 27
    assert fields[1] == "2024-03-12 10:15:30" and fields[9:11] == ["90.0", "SRID=4326;POINT(4.5 52.25)"]
    assert fields[15] == "t" and json.loads(fields[21]) == [{"brandstof": "Diesel", "volgnr": 1}]
    # an empty text is quoted, a missing value is not
    assert text["2024-03-12"].split(";")[4:6] == ['""', "1"]
    (fields,) = csv.reader(text["2024-03-13"].splitlines(), delimiter=";")
    assert fields[15] == "" and fields[4] == ""


def test_a_stray_day_is_left_as_it_was(spark, folder):
    path = folder + "/days"
    schema = "day date, n int"
    old = spark.createDataFrame([(date(2024, 1, 2), 1), (date(2024, 1, 3), 2)], schema)
    replace_days(old, path, "day", date(2024, 1, 2), date(2024, 1, 3))
    new = spark.createDataFrame([(date(2024, 1, 2), 7), (date(2024, 1, 3), 8), (None, 9)], schema)
    with pytest.raises(ValueError, match="2 rows outside"):
        replace_days(new, path, "day", date(2024, 1, 3), date(2024, 1, 3))
    stored = spark.read.parquet(path).select("day", "n")
    assert {tuple(r) for r in stored.collect()} == {(date(2024, 1, 2), 1), (date(2024, 1, 3), 8)}
