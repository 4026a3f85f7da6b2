from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from wayside.functions import bins, naming
from wayside.functions.calendar import (
    calendar_parts,
    hour_floor,
    last_week,
    local_day_bounds,
    local_time,
    minute_floor,
    weekday_label,
)
from wayside.functions.keys import canonical_uuid
from wayside.functions.privacy import mask
from wayside.operators.filters import by_attributes, in_local_days, newest


def labels(spark, table, values):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    return [row[0] for row in df.select(table.label(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "table, vectors",
    [
        (
            bins.TOTAL_WEIGHT_PASSAGE_HOUR,
            {
                0: "klasse01_0-3500",
                3500: "klasse01_0-3500",
                3501: "klasse02_3501-7500",
                7499: "klasse02_3501-7500",
                7500: "klasse03_7501-10000",
                80000: "klasse10_70001-80000",
                80001: "klasse11_80001",
                None: "klasse11_80001",
            },
        ),
        (
            bins.TOTAL_WEIGHT_HEAVY,
            {
                7500: "klasse02_3501-7500",
                7501: "klasse03_7501-10000",
                70000: "klasse09_60001-70000",
                70001: "klasse10_70001",
                None: "onbekend",
            },
        ),
        (
            bins.EMPTY_WEIGHT_HEAVY,
            {
                7501: "klasse03_7501-11250",
                11250: "klasse03_7501-11250",
                45000: "klasse07_30001-45000",
                45001: "klasse08_45001",
                None: "onbekend",
            },
        ),
        (bins.LENGTH_HOUR, {1000: "01 0t/m1000", 1001: "02 >1000", None: "03 onbekend"}),
        (bins.LENGTH_MINUTE, {1000: "01 <=1000", 1001: "02 >1000", None: "03 onbekend"}),
        (
            bins.WIDTH,
            {139: "01 0-140", 140: "03 onbekend", 141: "02 >140", None: "03 onbekend"},
        ),
    ],
)
def test_class_edges(spark, table, vectors):
    assert labels(spark, table, list(vectors)) == list(vectors.values())


@pytest.mark.parametrize(
    "country, weight, label",
    [
        ("NL", 0, "klasse 0 <= 3500"),
        ("NL", 3500, "klasse 0 <= 3500"),
        ("NL", 3501, "klasse 1 <= 7500"),
        ("NL", 7500, "klasse 1 <= 7500"),
        ("NL", 7501, "klasse 2 <= 11250"),
        ("NL", 11250, "klasse 2 <= 11250"),
        ("NL", 11251, "klasse 3 <= 30000"),
        ("NL", 30001, "klasse 4 <= 50000"),
        ("NL", 50000, "klasse 4 <= 50000"),
        ("NL", 50001, "klasse 5 > 50000"),
        ("NL", 99999, "klasse 5 > 50000"),
        ("NL", None, "onbekend"),
        ("BE", 3000, "buitenland"),
        (None, 3000, "klasse 0 <= 3500"),
    ],
)
def test_cordon_weight_class(spark, country, weight, label):
    df = spark.createDataFrame([(country, weight)], "c string, w int")
    assert df.select(bins.cordon_weight_class(F.col("c"), F.col("w"))).first()[0] == label


def at(spark, *times):
    return spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")


def test_iso_week_keeps_the_calendar_year(spark):
    df = at(spark, datetime(2021, 1, 3, 4, 5))
    row = df.select(*[c.alias(n) for n, c in calendar_parts(F.col("ts")).items()]).first()
    assert row.asDict() == {
        "date": date(2021, 1, 3),
        "year": 2021,
        "month": 1,
        "day": 3,
        "week": 53,
        "day_of_week": 0,
        "hour": 4,
    }


def test_clock_changes(spark):
    df = at(
        spark,
        datetime(2024, 10, 27, 0, 30),
        datetime(2024, 10, 27, 1, 30),
        datetime(2024, 3, 31, 1, 30),
    )
    hours = [row[0] for row in df.select(F.hour(local_time(F.col("ts")))).collect()]
    assert hours == [2, 2, 3]
    assert local_day_bounds(date(2024, 3, 31), date(2024, 3, 31)) == (
        datetime(2024, 3, 30, 23),
        datetime(2024, 3, 31, 22),
    )
    start, end = local_day_bounds(date(2024, 10, 27), date(2024, 10, 27))
    assert (end - start).total_seconds() == 25 * 3600


def test_truncation_keeps_the_zoneless_type(spark):
    df = at(spark, datetime(2024, 3, 31, 2, 59, 59, 999999)).select(
        hour_floor(F.col("ts")).alias("h"), minute_floor(F.col("ts")).alias("m")
    )
    assert dict(df.dtypes) == {"h": "timestamp_ntz", "m": "timestamp_ntz"}
    assert df.first() == (datetime(2024, 3, 31, 2), datetime(2024, 3, 31, 2, 59))


def test_weekday_labels(spark):
    df = at(spark, *[datetime(2024, 3, 4 + n) for n in range(7)])
    assert [r[0] for r in df.select(weekday_label(F.col("ts"))).collect()] == [
        "1 maandag",
        "2 dinsdag",
        "3 woensdag",
        "4 donderdag",
        "5 vrijdag",
        "6 zaterdag",
        "7 zondag",
    ]


def test_last_week_is_the_whole_week_before():
    assert last_week(date(2021, 1, 4)) == (date(2020, 12, 28), date(2021, 1, 3))
    assert last_week(date(2021, 1, 10)) == (date(2020, 12, 28), date(2021, 1, 3))


def test_field_names(spark):
    assert naming.snake_case("co2UitstootGecombineerd") == "co2_uitstoot_gecombineerd"
    assert naming.camel_case("co2_uitstoot_gecombineerd") == "co2UitstootGecombineerd"
    df = spark.sql(
        "select named_struct('innerName', 1, 'fuelList', array(named_struct('keptName', 2)))"
        " as outerName"
    )
    renamed = naming.to_snake_case(df)
    assert renamed.schema.simpleString() == (
        "struct<outer_name:struct<inner_name:int,fuel_list:array<struct<keptName:int>>>>"
    )
    kept = naming.keep_fields(df, lambda name: name != "fuelList")
    assert kept.schema.simpleString() == "struct<outerName:struct<innerName:int>>"


def test_masks(make_passages):
    df = mask(
        make_passages(
            *[{"toegestane_maximum_massa_voertuig": w, "merk": "m",
               "europese_voertuigcategorie_toevoeging": "G"}
              for w in (None, 0, 1500, 3500, 3501, 9999)]
        )
    ).orderBy("passage_id")
    rows = df.collect()
    assert [r.toegestane_maximum_massa_voertuig for r in rows] == [None, 1500, 1500, 1500, 3501, 9999]
    assert [r.merk for r in rows] == ["m", None, None, None, "m", "m"]
    assert [r.europese_voertuigcategorie_toevoeging for r in rows] == [
        "G", None, None, None, "G", "G"
    ]


def test_date_and_body_masks(make_passages):
    days = [date(2021, 1, 1), date(2020, 12, 31), date(2019, 8, 17), None]
    kinds = ["personenauto", "PERSONENAUTO", "Bus", None]
    rows = mask(
        make_passages(
            *[{"datum_eerste_toelating": d, "datum_tenaamstelling": date(2020, 2, 2),
               "voertuig_soort": k, "inrichting": "kept"} for d, k in zip(days, kinds)]
        )
    ).orderBy("passage_id").collect()
    assert [r.datum_eerste_toelating for r in rows] == [
        date(2021, 1, 1), date(2020, 1, 1), date(2019, 1, 1), None
    ]
    assert {r.datum_tenaamstelling for r in rows} == {None}
    assert [r.inrichting for r in rows] == ["Personenauto", "Personenauto", "kept", "kept"]


def test_uuid_spellings(spark):
    plain = "0123456789abcdef0123456789abcdef"
    want = "01234567-89ab-cdef-0123-456789abcdef"
    given = [plain, plain.upper(), want, "{" + want + "}", "urn:uuid:" + want, "nonsense", plain[1:]]
    df = spark.createDataFrame([(g,) for g in given], "t string")
    assert [r[0] for r in df.select(canonical_uuid(F.col("t"))).collect()] == [want] * 5 + [None] * 2


def test_local_day_filter(make_passages):
    times = [datetime(2024, 3, 30, 22, 59, 59), datetime(2024, 3, 30, 23),
             datetime(2024, 3, 31, 21, 59, 59), datetime(2024, 3, 31, 22)]
    found = in_local_days(make_passages(*[{"passage_at": t} for t in times]), date(2024, 3, 31))
    assert sorted(r.passage_at for r in found.collect()) == times[1:3]


def test_attribute_filters(make_passages):
    df = make_passages({"diesel": 1}, {"diesel": 0}, {"diesel": None})
    assert by_attributes(df, diesel__isnull=False, diesel__lt=1).count() == 1
    assert by_attributes(df, passage_at=datetime(2024, 3, 12, 10, 15, 30)).count() == 3
    with pytest.raises(ValueError):
        by_attributes(df, merk__lt="a")
    with pytest.raises(ValueError):
        by_attributes(df, straat="x")


def test_pages_follow_each_other(make_passages):
    times = [datetime(2024, 3, 12, n // 3) for n in range(12)]
    df = make_passages(*[{"passage_at": t} for t in times])
    seen, after = [], None
    while page := newest(df, 5, after).collect():
        seen += [r.passage_id for r in page]
        after = page[-1].asDict()
    assert len(seen) == len(set(seen)) == 12
    assert newest(df, 1).first().passage_at == max(times)


def test_a_page_beyond_the_limit_is_an_error(make_passages):
    with pytest.raises(ValueError):
        newest(make_passages({}), 10_001)
