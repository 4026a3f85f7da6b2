"""Every operator as a query over the whole derived tables, next to the SQL that
must give the same rows.

The SQL is a second formulation, not a transcription: classes are looked up in
value ranges, first rows are ranked, refreshes are stated as their end result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks.derived import (
    areas,
    cameras,
    passage_columns,
    passages,
    passages_of,
    with_tables,
)
from checks.payloads import flat_payloads, nested_payloads
from wayside.functions import bins, naming
from wayside.functions.calendar import (
    ZONE_SETTING,
    calendar_parts,
    hour_floor,
    local_time,
    minute_floor,
    weekday_label,
)
from wayside.functions.privacy import mask
from wayside.operators import (
    dedup,
    export,
    filters,
    ingest,
    profiles,
    quality,
    taxi,
    traffic,
)
from wayside.operators.cameras import with_cameras
from wayside.plans import answers, refresh
from wayside.plans.counts import read_counts
from wayside.plans.ingest import ingest_batch
from wayside.plans.rewrite import begin_masking
from wayside.schemas import NATURAL_KEY, PASSAGE_DAY
from wayside.session import configure, scratch_path
from wayside.sources.batches import add_batch
from wayside.sources.lease import only_writer
from wayside.sources.passages import append_passages, read_passages, with_day
from wayside.sources.reference_data import (
    CAMERA_CSV,
    load_cameras,
    load_taxi_areas,
    read_helper,
    replace_table,
)
from wayside.sources.sinks import write_delivery_csv, write_hourly_csv
from wayside.streaming.ingest import start_ingest
from wayside.streaming.windows import start_counts, start_storing

# A zone whose clocks have gone with the roadside's since 1970.
ZONE = "Europe/Brussels"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark).conf.set(ZONE_SETTING, ZONE)
            return query(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return query

    return register


# ---------------------------------------------------------------- SQL pieces


# The first and last whole number of every class and its label, and the
# label of a missing value.  Written out here, so that a wrong class in the library
# does not also change what it is compared with.
LOWEST, HIGHEST = -2147483648, 2147483647
PASSAGE_HOUR_WEIGHT = [
    (LOWEST, 3500, "klasse01_0-3500"),
    (3501, 7499, "klasse02_3501-7500"),
    (7500, 10000, "klasse03_7501-10000"),
    (10001, 20000, "klasse04_10001-20000"),
    (20001, 30000, "klasse05_20001-30000"),
    (30001, 40000, "klasse06_30001-40000"),
    (40001, 50000, "klasse07_40001-50000"),
    (50001, 60000, "klasse08_50001-60000"),
    (60001, 70000, "klasse09_60001-70000"),
    (70001, 80000, "klasse10_70001-80000"),
    (80001, HIGHEST, "klasse11_80001"),
    "klasse11_80001",
]
CORDON_WEIGHT = [
    (LOWEST, 3500, "klasse 0 <= 3500"),
    (3501, 7500, "klasse 1 <= 7500"),
    (7501, 11250, "klasse 2 <= 11250"),
    (11251, 30000, "klasse 3 <= 30000"),
    (30001, 50000, "klasse 4 <= 50000"),
    (50001, HIGHEST, "klasse 5 > 50000"),
    "onbekend",
]
HEAVY_WEIGHT = [
    (LOWEST, 3500, "klasse01_0-3500"),
    (3501, 7500, "klasse02_3501-7500"),
    (7501, 10000, "klasse03_7501-10000"),
    (10001, 20000, "klasse04_10001-20000"),
    (20001, 30000, "klasse05_20001-30000"),
    (30001, 40000, "klasse06_30001-40000"),
    (40001, 50000, "klasse07_40001-50000"),
    (50001, 60000, "klasse08_50001-60000"),
    (60001, 70000, "klasse09_60001-70000"),
    (70001, HIGHEST, "klasse10_70001"),
    "onbekend",
]
HEAVY_EMPTY_WEIGHT = [
    (LOWEST, 3500, "klasse01_0-3500"),
    (3501, 7500, "klasse02_3501-7500"),
    (7501, 11250, "klasse03_7501-11250"),
    (11251, 15000, "klasse04_11251-15000"),
    (15001, 20000, "klasse05_15001-20000"),
    (20001, 30000, "klasse06_20001-30000"),
    (30001, 45000, "klasse07_30001-45000"),
    (45001, HIGHEST, "klasse08_45001"),
    "onbekend",
]
HOUR_LENGTH = [(LOWEST, 1000, "01 0t/m1000"), (1001, HIGHEST, "02 >1000"), "03 onbekend"]
MINUTE_LENGTH = [(LOWEST, 1000, "01 <=1000"), (1001, HIGHEST, "02 >1000"), "03 onbekend"]
VEHICLE_WIDTH = [(LOWEST, 139, "01 0-140"), (141, HIGHEST, "02 >140"), "03 onbekend"]


def sql_bin(classes: list, value: str) -> str:
    """The class of a value, looked up in a table of ranges."""
    *ranges, missing = classes
    rows = [f"({low}, {high}, '{label}')" for low, high, label in ranges]
    found = (
        f"(select label from (values {', '.join(rows)}) as b(low, high, label)"
        f" where {value} between b.low and b.high)"
    )
    return f"coalesce({found}, '{missing}')"


def sql_part(part: str, ts: str) -> str:
    return f"cast(extract({part} from {ts}) as integer)"


def sql_local(ts: str) -> str:
    return f"({ts} at time zone 'UTC' at time zone '{ZONE}')"


def sql_calendar(ts: str, prefix: str = "passage_at_", dow: str = "day_of_week") -> str:
    weekday = sql_part("dow", ts)
    if prefix:
        weekday = f"cast({weekday} as varchar)"
    parts = [f"cast({ts} as date) as {prefix}date", f"{weekday} as {prefix}{dow}"]
    for part in ("year", "month", "day", "week", "hour"):
        parts.append(f"{sql_part(part, ts)} as {prefix}{part}")
    return ", ".join(parts)


SQL_HOUR = "cast(date_trunc('hour', passage_at) as timestamp)"
SQL_WEEKDAY = (
    "list_extract(['7 zondag', '1 maandag', '2 dinsdag', '3 woensdag', '4 donderdag',"
    " '5 vrijdag', '6 zaterdag'], cast(extract(dow from {ts}) as integer) + 1)"
)
SQL_ID = (
    "concat_ws('-', substr(passage_id, 1, 8), substr(passage_id, 9, 4),"
    " substr(passage_id, 13, 4), substr(passage_id, 17, 4), substr(passage_id, 21, 12))"
)
SQL_LANE = (
    "p.camera_naam = c.camera_naam and p.camera_kijkrichting = c.camera_kijkrichting"
    " and p.rijrichting = c.rijrichting"
)
WEIGHT = "toegestane_maximum_massa_voertuig"

SQL_MASKED = {
    "datum_eerste_toelating": "make_date(year(datum_eerste_toelating), 1, 1)",
    "datum_tenaamstelling": "cast(null as date)",
    WEIGHT: f"if({WEIGHT} <= 3500, 1500, {WEIGHT})",
    "europese_voertuigcategorie_toevoeging": (
        f"if({WEIGHT} <= 3500, null, europese_voertuigcategorie_toevoeging)"
    ),
    "merk": f"if({WEIGHT} <= 3500, null, merk)",
    "inrichting": (
        "if(lower(voertuig_soort) = 'personenauto', 'Personenauto', inrichting)"
    ),
}
SQL_MASKS = ", ".join(f"{text} as {name}" for name, text in SQL_MASKED.items())


def points(df: DataFrame, column: str) -> DataFrame:
    """A point column as two plain ones."""
    return df.withColumns(
        {"punt_x": F.col(f"{column}.x"), "punt_y": F.col(f"{column}.y")}
    ).drop(column)


# ------------------------------------------------------------------- sources

PLAIN = [
    "passage_id",
    "volgnummer",
    "passage_at",
    "created_at",
    "straat",
    "rijrichting",
    "rijstrook",
    "camera_id",
    "camera_naam",
    "camera_kijkrichting",
    "kenteken_land",
    "voertuig_soort",
    WEIGHT,
    "kenteken_hash",
    "taxi_indicator",
    "electric",
]
SQL_PLAIN = ", ".join(PLAIN)


@check(
    "scan_passages",
    f"""select {SQL_PLAIN}, cast(passage_at as date) as passage_date from passages
    where cast(passage_at as date) between date '2000-01-01' and date '2000-10-29'""",
)
def scan_passages(spark, sf_dir):
    path = scratch_path(spark, "passages")
    append_passages(passages(spark, sf_dir, fuels_as_text=False), path)
    stored = read_passages(spark, path, date(2000, 1, 1), date(2000, 10, 29))
    return stored.select(*PLAIN, PASSAGE_DAY)


@check(
    "append_passages",
    f"select {SQL_PLAIN}, brandstoffen, cast(passage_at as date) as passage_date from passages",
)
def append_passages_query(spark, sf_dir):
    path = scratch_path(spark, "passages")
    append_passages(passages(spark, sf_dir, fuels_as_text=False), path)
    stored = read_passages(spark, path)
    return stored.select(*PLAIN, F.to_json("brandstoffen").alias("brandstoffen"), PASSAGE_DAY)


def in_batches(spark, sf_dir):
    """A table of three batches, with its log."""
    table = scratch_path(spark, "passages")
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    for n in range(3):
        with only_writer(spark, table) as lease:
            add_batch(lease, passages_of(lineitem.filter(f"l_orderkey % 3 = {n}")))
    return table


@check(
    "load_cameras",
    """select camera_id, vma_linknr, camera_naam, rijrichting, rijrichting_correct,
    camera_kijkrichting, order_kaart, order_naam, cordon, richting, punt_x, punt_y, geom, azimuth
    from cameras""",
)
def load_cameras_query(spark, sf_dir):
    path = scratch_path(spark, "cameras-csv")
    correct = F.col("rijrichting_correct")
    written = cameras(spark, sf_dir).withColumns(
        {
            "latitude": F.col("location.x"),
            "longitude": F.col("location.y"),
            "rijrichting_correct": F.when(correct, "Ja").when(~correct, "nee"),
        }
    )
    written.select(*CAMERA_CSV).write.option("header", True).csv(path)
    helpers = scratch_path(spark, "helpers")
    replace_table(load_cameras(spark, path).limit(1), "cameras", helpers)
    replace_table(load_cameras(spark, path), "cameras", helpers)
    return points(read_helper(spark, "cameras", helpers), "location")


@check(
    "load_taxi_areas",
    "select id, gebiedstype, gebied, if(camera_id = '', '-', camera_id) as camera_id from areas",
)
def load_taxi_areas_query(spark, sf_dir):
    path = scratch_path(spark, "areas-csv")
    pattern = F.when(F.col("camera_id") == "", "-").otherwise(F.col("camera_id"))
    areas(spark, sf_dir).withColumn("camera_id", pattern).write.option("header", True).csv(path)
    helpers = scratch_path(spark, "helpers")
    replace_table(load_taxi_areas(spark, path), "taxi_areas", helpers)
    return read_helper(spark, "taxi_areas", helpers)


# -------------------------------------------------------------------- ingest

NOW = datetime(2000, 11, 1, 12)
INGESTED = [
    "passage_id",
    "volgnummer",
    "passage_at",
    "created_at",
    "version",
    "straat",
    "rijrichting",
    "rijstrook",
    "camera_id",
    "camera_naam",
    "camera_kijkrichting",
    "kenteken_land",
    "kenteken_nummer_betrouwbaarheid",
    "kenteken_land_betrouwbaarheid",
    "indicatie_snelheid",
    "automatisch_verwerkbaar",
    "voertuig_soort",
    "merk",
    "inrichting",
    "datum_eerste_toelating",
    "datum_tenaamstelling",
    WEIGHT,
    "europese_voertuigcategorie",
    "europese_voertuigcategorie_toevoeging",
    "taxi_indicator",
    "diesel",
    "gasoline",
    "electric",
    "kenteken_hash",
    "massa_ledig_voertuig",
    "aantal_staanplaatsen",
    "aantal_zitplaatsen",
    "handelsbenaming",
    "lengte",
    "breedte",
]


def sql_ingested(**changed: str) -> str:
    given = {
        **{name: name for name in INGESTED},
        "passage_id": SQL_ID,
        "created_at": "timestamp '2000-11-01 12:00:00'",
        **SQL_MASKED,
        **changed,
    }
    return ", ".join(f"{text} as {name}" for name, text in given.items())


# The nested payload has one list of fuels, from which the flags follow.
SQL_FUEL_FLAGS = {
    "diesel": "cast(case brandstoffen[16:18] when 'Die' then 1 when 'Ele' then 0 end as smallint)",
    "gasoline": "cast(if(brandstoffen is null, null, 0) as smallint)",
    "electric": (
        "cast(case brandstoffen[16:18] when 'Die' then 0 when 'Ele' then 1 end as smallint)"
    ),
}
SQL_VALID = "kenteken_nummer_betrouwbaarheid <= 1000"


def ingested(df: DataFrame) -> DataFrame:
    return points(df.select(*INGESTED, "camera_locatie"), "camera_locatie")


def flat_lines(spark, sf_dir):
    return flat_payloads(passages(spark, sf_dir, fuels_as_text=False))


def nested_lines(spark, sf_dir):
    return nested_payloads(passages(spark, sf_dir, fuels_as_text=False))


@check(
    "ingest_v1",
    f"select {sql_ingested()}, punt_x, punt_y from passages where {SQL_VALID}",
)
def ingest_v1(spark, sf_dir):
    validated = ingest.read_validated(flat_lines(spark, sf_dir), "v1")
    return ingested(ingest.to_passages(validated, NOW))


@check(
    "ingest_v2",
    f"select {sql_ingested(**SQL_FUEL_FLAGS)}, punt_x, punt_y from passages where {SQL_VALID}",
)
def ingest_v2(spark, sf_dir):
    validated = ingest.read_validated(nested_lines(spark, sf_dir), "v2")
    return ingested(ingest.to_passages(validated, NOW))


@check(
    "ingest_both",
    f"""select distinct {SQL_ID} as passage_id, volgnummer, passage_at, camera_id,
    voertuig_soort, if(l_partkey % 4 = 0, 'passage-v1', 'passage-v2') as version
    from passages where {SQL_VALID}""",
)
def ingest_both(spark, sf_dir):
    """A quarter of the passages come flat in one batch, all come nested in the next
    one, together with the flat ones again."""
    root = scratch_path(spark, "both")
    everything = passages(spark, sf_dir, fuels_as_text=False)
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    some = passages_of(lineitem.filter("l_partkey % 4 = 0")).withColumn(
        "version", F.lit("passage-v1")
    )
    flat, nested = flat_payloads(some), nested_payloads(everything)
    places = [f"{root}/{name}" for name in ("passages", "invalid", "duplicates")]
    ingest_batch({"v1": flat}, *places, batch=0, now=NOW)
    ingest_batch({"v1": flat, "v2": nested}, *places, batch=1, now=NOW)
    return read_passages(spark, places[0]).select(*KEYED, "version")


@check(
    "normalize_v2",
    f"""select {SQL_ID} as passage_id, volgnummer, passage_at, version, rijrichting, punt_x,
    punt_y, camera_id, camera_naam, camera_kijkrichting, straat, rijstrook,
    automatisch_verwerkbaar, indicatie_snelheid, kenteken_land, kenteken_hash,
    kenteken_land_betrouwbaarheid, kenteken_nummer_betrouwbaarheid,
    {', '.join(f'{text} as {name}' for name, text in SQL_FUEL_FLAGS.items())},
    make_date(year(datum_eerste_toelating), 1, 1) as datum_eerste_toelating,
    coalesce(brandstoffen, '[]') as brandstoffen from passages""",
)
def normalize_v2(spark, sf_dir):
    flat = ingest.flatten_v2(ingest.parse_payloads(nested_lines(spark, sf_dir), "v2"))
    typed = points(ingest.validate(flat), "camera_locatie")
    as_given = F.to_json(
        F.transform(
            "brandstoffen",
            lambda fuel: F.struct(
                fuel["brandstof"].alias("brandstof"), fuel["volgnummer"].alias("volgnr")
            ),
        )
    )
    return typed.withColumn("brandstoffen", as_given).select(
        "passage_id",
        "volgnummer",
        "passage_at",
        "version",
        "rijrichting",
        "punt_x",
        "punt_y",
        "camera_id",
        "camera_naam",
        "camera_kijkrichting",
        "straat",
        "rijstrook",
        "automatisch_verwerkbaar",
        "indicatie_snelheid",
        "kenteken_land",
        "kenteken_hash",
        "kenteken_land_betrouwbaarheid",
        "kenteken_nummer_betrouwbaarheid",
        "diesel",
        "gasoline",
        "electric",
        "datum_eerste_toelating",
        "brandstoffen",
    )


@check(
    "snake_case_columns",
    """select passage_id as id, camera_naam as naam, kenteken_hash,
    cast(aantal_zitplaatsen as varchar) as aantal_zitplaatsen,
    cast(year(datum_eerste_toelating) as varchar) as jaar_eerste_toelating,
    cast(kenteken_land_betrouwbaarheid as varchar) as landcode_betrouwbaarheid,
    cast(automatisch_verwerkbaar as varchar) as automatisch_verwerkbaar
    from passages""",
)
def snake_case_columns(spark, sf_dir):
    renamed = naming.to_snake_case(ingest.parse_payloads(nested_lines(spark, sf_dir), "v2"))
    return renamed.select(
        "id",
        "camera.naam",
        "voertuig.kenteken.kenteken_hash",
        "voertuig.aantal_zitplaatsen",
        "voertuig.jaar_eerste_toelating",
        "voertuig.kenteken.betrouwbaarheid.landcode_betrouwbaarheid",
        "automatisch_verwerkbaar",
    )


_CAMEL = {
    "passage_id": "passageId",
    "passage_at": "passageAt",
    "camera_kijkrichting": "cameraKijkrichting",
    "kenteken_land_betrouwbaarheid": "kentekenLandBetrouwbaarheid",
    WEIGHT: "toegestaneMaximumMassaVoertuig",
    "lengte": "lengte",
}


@check(
    "camel_case_columns",
    "select "
    + ", ".join(f"{name} as {camel}" for name, camel in _CAMEL.items())
    + " from passages",
)
def camel_case_columns(spark, sf_dir):
    wanted = passages(spark, sf_dir).drop("brandstoffen")
    kept = naming.keep_fields(wanted, lambda name: name in _CAMEL)
    return naming.to_camel_case(kept)


@check(
    "validate_passages",
    f"""select {SQL_ID} as passage_id, volgnummer, passage_at, kenteken_nummer_betrouwbaarheid
    from passages where {SQL_VALID}""",
)
def validate_passages(spark, sf_dir):
    validated = ingest.read_validated(flat_lines(spark, sf_dir), "v1")
    return ingest.accepted(validated).select(
        "passage_id", "volgnummer", "passage_at", "kenteken_nummer_betrouwbaarheid"
    )


@check(
    "rejected_passages",
    f"""select passage_id, volgnummer, 'kenteken_nummer_betrouwbaarheid:range' as failed_rules
    from passages where not {SQL_VALID}""",
)
def rejected_passages(spark, sf_dir):
    turned_down = ingest.rejected(ingest.read_validated(flat_lines(spark, sf_dir), "v1"))
    return turned_down.select(
        F.get_json_object("payload", "$.id").alias("passage_id"),
        F.get_json_object("payload", "$.volgnummer").cast("int").alias("volgnummer"),
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )


@check("privacy_mask", f"select passage_id, volgnummer, passage_at, {SQL_MASKS} from passages")
def privacy_mask(spark, sf_dir):
    return mask(passages(spark, sf_dir)).select(
        "passage_id", "volgnummer", "passage_at", *SQL_MASKED
    )


# Every passage arrives a second time, up to two seconds later; a third of the
# copies are equal in every column.
COPIED = ["passage_id", "volgnummer", "passage_at", "created_at", "camera_id", WEIGHT, "lengte"]
_SQL_COPIED = ", ".join(COPIED)
_SQL_ARRIVED = f"""(select {_SQL_COPIED} from passages union all
    select {_SQL_COPIED.replace('created_at', 'created_at + to_seconds(l_partkey % 3)')
    .replace('l_partkey % 3)', 'l_partkey % 3) as created_at')} from passages)"""
_SQL_RANKED = f"""(select *, row_number() over (partition by passage_id, volgnummer, passage_at
    order by created_at, camera_id nulls first, {WEIGHT} nulls first, lengte nulls first) as rn
    from {_SQL_ARRIVED})"""


def arrived(spark, sf_dir):
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    given = {name: F.expr(passage_columns("spark")[name]) for name in COPIED}
    delay = F.make_dt_interval(secs=F.col("l_partkey") % 3)
    first = lineitem.select(*[column.alias(name) for name, column in given.items()])
    given["created_at"] = given["created_at"] + delay
    second = lineitem.select(*[column.alias(name) for name, column in given.items()])
    return first.unionByName(second)


@check("dedup_passages", f"select {_SQL_COPIED} from {_SQL_RANKED} where rn = 1")
def dedup_passages(spark, sf_dir):
    return dedup.first_of_key(arrived(spark, sf_dir))


@check(
    "duplicate_passages",
    f"select {_SQL_COPIED}, count(*) as copies from {_SQL_RANKED} where rn > 1 group by all",
)
def duplicate_passages(spark, sf_dir):
    return dedup.later_copies(arrived(spark, sf_dir))


@check(
    "new_passages",
    f"""select passage_id, volgnummer, passage_at, camera_id from passages
    where kenteken_land is null or kenteken_land <> 'NL'""",
)
def new_passages(spark, sf_dir):
    """Against a table that already holds the home vehicles."""
    path = scratch_path(spark, "history")
    everything = passages(spark, sf_dir, fuels_as_text=False)
    append_passages(everything.filter("kenteken_land = 'NL'"), path)
    history = dedup.same_days(read_passages(spark, path), everything)
    found = dedup.not_stored(everything, history)
    return found.select("passage_id", "volgnummer", "passage_at", "camera_id")


@check(
    "bulk_privacy",
    f"""select passage_id, volgnummer, passage_at, cast(passage_at as date) as passage_date,
    {SQL_MASKS} from passages""",
)
def bulk_privacy(spark, sf_dir):
    """A third of the passages come while the others are being masked."""
    table = scratch_path(spark, "history")
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    append_passages(passages_of(lineitem.filter("l_partkey % 3 <> 0")), table)
    masking = begin_masking(spark, table)
    with only_writer(spark, table) as lease:
        add_batch(lease, passages_of(lineitem.filter("l_partkey % 3 = 0")))
    masking.finish()
    masked = read_passages(spark, table)
    return masked.select("passage_id", "volgnummer", "passage_at", PASSAGE_DAY, *SQL_MASKED)


# ------------------------------------------------------------------- filters


@check(
    "filter_utc_day",
    f"select {SQL_PLAIN} from passages where cast(passage_at as date) = date '2000-03-26'",
)
def filter_utc_day(spark, sf_dir):
    return filters.in_utc_days(passages(spark, sf_dir), date(2000, 3, 26)).select(*PLAIN)


@check(
    "filter_local_day",
    f"""select {SQL_PLAIN} from passages
    where cast({sql_local('passage_at')} as date) = date '2000-03-26'""",
)
def filter_local_day(spark, sf_dir):
    return filters.in_local_days(passages(spark, sf_dir), date(2000, 3, 26)).select(*PLAIN)


@check(
    "filter_passages",
    f"""select {SQL_PLAIN} from passages where voertuig_soort = 'Bus' and electric is null
    and passage_at > timestamp '2000-03-25 12:00:00' and gasoline < 1""",
)
def filter_passages(spark, sf_dir):
    return filters.by_attributes(
        passages(spark, sf_dir),
        voertuig_soort="Bus",
        electric__isnull=True,
        passage_at__gt=datetime(2000, 3, 25, 12),
        gasoline__lt=1,
    ).select(*PLAIN)


@check(
    "newest_passages",
    f"""select {SQL_PLAIN} from passages
    order by passage_at desc, passage_id, volgnummer limit 50""",
)
def newest_passages(spark, sf_dir):
    return answers.newest_page(spark, in_batches(spark, sf_dir)).select(*PLAIN)


@check(
    "next_page",
    f"""select {SQL_PLAIN} from passages where kenteken_land = 'BE'
    order by passage_at desc, passage_id, volgnummer limit 40 offset 40""",
)
def next_page(spark, sf_dir):
    """The second page of those that meet a criterion, by the key of the first one's end."""
    table = in_batches(spark, sf_dir)
    first = answers.newest_page(spark, table, 40, kenteken_land="BE").collect()
    after = {name: first[-1][name] for name in NATURAL_KEY}
    return answers.newest_page(spark, table, 40, after, kenteken_land="BE").select(*PLAIN)


# ------------------------------------------------------------------ calendar


@check(
    "calendar_utc",
    f"""select passage_id, volgnummer, {sql_calendar('passage_at', '', 'day_of_week')},
    {SQL_HOUR} as hour_start from passages""",
)
def calendar_utc(spark, sf_dir):
    at = F.col("passage_at")
    parts = [column.alias(name) for name, column in calendar_parts(at).items()]
    return passages(spark, sf_dir).select(
        "passage_id", "volgnummer", *parts, hour_floor(at).alias("hour_start")
    )


@check(
    "calendar_local",
    f"""select passage_id, volgnummer, {sql_calendar('local_at', '', 'day_of_week')},
    {sql_part('minute', 'local_at')} as minute, local_at,
    cast(date_trunc('minute', local_at) as timestamp) as minute_start
    from (select *, {sql_local('passage_at')} as local_at from passages)""",
)
def calendar_local(spark, sf_dir):
    df = passages(spark, sf_dir).withColumn("local_at", local_time(F.col("passage_at")))
    at = F.col("local_at")
    parts = [column.alias(name) for name, column in calendar_parts(at).items()]
    return df.select(
        "passage_id",
        "volgnummer",
        *parts,
        F.minute(at).alias("minute"),
        at,
        minute_floor(at).alias("minute_start"),
    )


@check(
    "dow_label",
    f"""select passage_id, volgnummer, {SQL_WEEKDAY.format(ts='passage_at')} as weekday
    from passages""",
)
def dow_label(spark, sf_dir):
    label = weekday_label(F.col("passage_at")).alias("weekday")
    return passages(spark, sf_dir).select("passage_id", "volgnummer", label)


# ---------------------------------------------------------------------- bins


def bin_check(name: str, table: bins.Bins, classes: list, column: str) -> None:
    @check(
        name,
        f"""select passage_id, volgnummer, {column}, {sql_bin(classes, column)} as label
        from passages""",
    )
    def query(spark, sf_dir):
        return passages(spark, sf_dir).select(
            "passage_id", "volgnummer", column, table.label(F.col(column)).alias("label")
        )


bin_check("bin_weight_hour", bins.TOTAL_WEIGHT_PASSAGE_HOUR, PASSAGE_HOUR_WEIGHT, WEIGHT)
bin_check("bin_weight_v2", bins.TOTAL_WEIGHT_HEAVY, HEAVY_WEIGHT, WEIGHT)
bin_check(
    "bin_empty_weight", bins.EMPTY_WEIGHT_HEAVY, HEAVY_EMPTY_WEIGHT, "massa_ledig_voertuig"
)
bin_check("bin_length", bins.LENGTH_HOUR, HOUR_LENGTH, "lengte")
bin_check("bin_length_minute", bins.LENGTH_MINUTE, MINUTE_LENGTH, "lengte")
bin_check("bin_width", bins.WIDTH, VEHICLE_WIDTH, "breedte")

SQL_CORDON_CLASS = (
    f"if(kenteken_land <> 'NL', 'buitenland', {sql_bin(CORDON_WEIGHT, WEIGHT)})"
)


@check(
    "bin_weight_heavy_v1",
    f"""select passage_id, volgnummer, kenteken_land, {WEIGHT}, {SQL_CORDON_CLASS} as label
    from passages""",
)
def bin_weight_heavy_v1(spark, sf_dir):
    label = bins.cordon_weight_class(F.col("kenteken_land"), F.col(WEIGHT)).alias("label")
    return passages(spark, sf_dir).select(
        "passage_id", "volgnummer", "kenteken_land", WEIGHT, label
    )


# --------------------------------------------------------------------- joins


@check(
    "join_camera_left",
    f"""select p.passage_id, p.volgnummer, p.camera_naam, p.camera_kijkrichting, p.rijrichting,
    c.camera_id as c_camera_id, c.cordon as c_cordon, c.order_kaart as c_order_kaart
    from passages p left join cameras c on {SQL_LANE}""",
)
def join_camera_left(spark, sf_dir):
    wanted = ["camera_id", "cordon", "order_kaart"]
    joined = with_cameras(passages(spark, sf_dir), cameras(spark, sf_dir), wanted)
    return joined.select(
        "passage_id",
        "volgnummer",
        "camera_naam",
        "camera_kijkrichting",
        "rijrichting",
        *[f"c_{name}" for name in wanted],
    )


@check(
    "join_area_like",
    """select distinct p.passage_id, p.volgnummer, p.passage_at, p.camera_naam, a.gebiedstype,
    a.gebied from passages p join areas a on p.camera_naam like '%' || a.camera_id || '%'
    where a.camera_id <> ''""",
)
def join_area_like(spark, sf_dir):
    keys = ["passage_id", "volgnummer", "passage_at", "camera_naam"]
    wanted = passages(spark, sf_dir).select(*keys)
    joined = taxi.with_areas(wanted, areas(spark, sf_dir), distinct=True)
    return joined.select(*keys, "gebiedstype", "gebied")


# ---------------------------------------------------------------- aggregates

SQL_PASSAGE_HOUR = f"""select {sql_calendar('passage_at', '', 'dow')}, camera_id, camera_naam,
    rijrichting, camera_kijkrichting, if(kenteken_land = 'NL', 'NL', 'overig') as kenteken_land,
    voertuig_soort, europese_voertuigcategorie, taxi_indicator, diesel, gasoline, electric,
    weight_class as {WEIGHT}, count(*) as count
    from (select *, {sql_bin(PASSAGE_HOUR_WEIGHT, WEIGHT)} as weight_class
    from passages) where {{days}} group by all"""


@check("agg_passage_hour", SQL_PASSAGE_HOUR.format(days="true"))
def agg_passage_hour(spark, sf_dir):
    return traffic.passage_hour(passages(spark, sf_dir))


SQL_CORDON_HOUR = f"""select hour_start as passage_at_timestamp,
    {sql_calendar('hour_start').replace(
        f"cast({sql_part('dow', 'hour_start')} as varchar)", SQL_WEEKDAY.format(ts='hour_start')
    )},
    order_kaart, order_naam, cordon, richting, punt_x, punt_y, geom, azimuth,
    kenteken_land, voertuig_soort, inrichting, voertuig_klasse_toegestaan_gewicht,
    count(*) as intensiteit from (
      select {SQL_HOUR} as hour_start, c.order_kaart, c.order_naam, c.cordon, c.richting,
      c.punt_x, c.punt_y, c.geom, c.azimuth,
      if(kenteken_land = 'NL', 'NL', 'buitenland') as kenteken_land, voertuig_soort,
      if(voertuig_soort = 'Personenauto', 'Personenauto', inrichting) as inrichting,
      {SQL_CORDON_CLASS} as voertuig_klasse_toegestaan_gewicht
      from passages p join cameras c on {SQL_LANE} where c.cordon in ('S100', 'A10'))
    group by all"""


@check("agg_heavy_v1", SQL_CORDON_HOUR)
def agg_heavy_v1(spark, sf_dir):
    hours = traffic.heavy_cordon_hour(passages(spark, sf_dir), cameras(spark, sf_dir))
    return points(hours, "location")


SQL_IGOR = f"""select hour_start as passage_at_timestamp, {sql_calendar('hour_start')},
    camera_id, camera_naam, vma_linknr, order_kaart, order_naam, cordon, richting, punt_x,
    punt_y, geom, azimuth, kenteken_land, taxi_indicator, europese_voertuigcategorie,
    count(*) as intensiteit from (
      select {SQL_HOUR} as hour_start, c.camera_id, c.camera_naam, c.vma_linknr, c.order_kaart,
      c.order_naam, c.cordon, c.richting, c.punt_x, c.punt_y, c.geom, c.azimuth,
      p.kenteken_land, p.taxi_indicator, p.europese_voertuigcategorie
      from passages p left join cameras c on {SQL_LANE}) group by all"""


@check("agg_igor_hour", SQL_IGOR)
def agg_igor_hour(spark, sf_dir):
    hours = traffic.igor_hour(passages(spark, sf_dir), cameras(spark, sf_dir))
    return points(hours, "location")


def sql_heavy(on: str, length: list, chosen: str, minute: bool) -> str:
    ts = "local_at"
    extra = f"{sql_part('minute', ts)} as passage_at_minute, kenteken_hash," if minute else ""
    bus = ", ".join(
        f"if(voertuig_soort = 'Bus', {name}, null) as {name}"
        for name in ("aantal_staanplaatsen", "aantal_zitplaatsen", "merk", "handelsbenaming")
    )
    return f"""select {sql_calendar(ts)}, {extra} camera_id, camera_naam, punt_x, punt_y,
    camera_kijkrichting, rijrichting, rijrichting_correct, straat, cordon, cordon_order_kaart,
    cordon_order_naam, richting, kenteken_land, empty_class as massa_ledig_voertuig,
    weight_class as {WEIGHT}, voertuig_soort, inrichting, europese_voertuigcategorie,
    europese_voertuigcategorie_toevoeging, brandstoffen, diesel, gasoline, electric,
    length_class as lengte, width_class as breedte, {bus}, count(*) as count from (
      select p.*, {sql_local('passage_at')} as local_at, c.rijrichting_correct, c.cordon,
      c.order_kaart as cordon_order_kaart, c.order_naam as cordon_order_naam, c.richting,
      {sql_bin(HEAVY_EMPTY_WEIGHT, 'massa_ledig_voertuig')} as empty_class,
      {sql_bin(HEAVY_WEIGHT, WEIGHT)} as weight_class,
      {sql_bin(length, 'lengte')} as length_class, {sql_bin(VEHICLE_WIDTH, 'breedte')} as width_class
      from passages p join cameras c on {on}
      where c.rijrichting_correct and ({chosen})) where {{days}} group by all"""


SQL_HEAVY_HOUR = sql_heavy(
    SQL_LANE, HOUR_LENGTH, f"voertuig_soort = 'Bedrijfsauto' or {WEIGHT} > 3500", False
)


@check("agg_heavy_v2", SQL_HEAVY_HOUR.format(days="true"))
def agg_heavy_v2(spark, sf_dir):
    hours = traffic.heavy_hour(passages(spark, sf_dir), cameras(spark, sf_dir))
    return points(hours, "camera_locatie")


@check(
    "agg_heavy_minute",
    sql_heavy(
        "p.camera_naam = c.camera_naam and p.rijrichting = c.rijrichting",
        MINUTE_LENGTH,
        f"{WEIGHT} > 3500",
        True,
    ).format(days="true"),
)
def agg_heavy_minute(spark, sf_dir):
    minutes = traffic.heavy_minute(passages(spark, sf_dir), cameras(spark, sf_dir))
    return points(minutes, "camera_locatie")


SQL_TAXI = f"""select cast(passage_at as date) as passage_at_date,
    {sql_part('hour', 'passage_at')} as hh, gebiedstype, gebied, electric,
    count(distinct kenteken_hash) as unieke_passages,
    count(distinct camera_naam) as check_on_camera_count
    from passages p join areas a on p.camera_naam like '%' || a.camera_id || '%'
    where taxi_indicator and electric is not null and a.camera_id <> '' and {{days}}
    group by all"""


@check("agg_taxi_hour", SQL_TAXI.format(days="true"))
def agg_taxi_hour(spark, sf_dir):
    return taxi.taxi_hour(passages(spark, sf_dir), areas(spark, sf_dir))


SQL_MINUTES = """select camera_id, camera_naam,
    cast(date_trunc('minute', passage_at) as timestamp) as passage_at_minute, count(*) as count
    from passages group by all"""


@check("minute_view", SQL_MINUTES)
def minute_view(spark, sf_dir):
    profiles.minute_counts(passages(spark, sf_dir)).createOrReplaceTempView("passage_minutes")
    return spark.table("passage_minutes")


@check("minute_view_snapshot", SQL_MINUTES)
def minute_view_snapshot(spark, sf_dir):
    path = scratch_path(spark, "minutes")
    profiles.minute_counts(passages(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)


@check(
    "camera_profile",
    """select straat, rijrichting, rijstrook, camera_id, camera_naam, camera_kijkrichting,
    punt_x, punt_y, count(*) as count from passages group by all""",
)
def camera_profile(spark, sf_dir):
    return points(profiles.camera_profile(passages(spark, sf_dir)), "camera_locatie")


_HASHED = ", ".join(
    f"md5({name}) as {name}" for name in profiles.HASHED_COLUMNS if name != "versit_klasse"
)


@check(
    "vehicle_profile",
    f"""select {_HASHED}, datum_eerste_toelating, cast(null as date) as datum_tenaamstelling,
    {WEIGHT}, if(taxi_indicator, 'TRUE', 'FALSE') as taxi_indicator,
    cast(null as smallint) as maximale_constructie_snelheid_bromsnorfiets, brandstoffen,
    cast(null as varchar) as extra_data, diesel, gasoline, electric,
    cast(null as varchar) as versit_klasse, count from (
      select kenteken_land, voertuig_soort, merk, inrichting, datum_eerste_toelating, {WEIGHT},
      europese_voertuigcategorie, europese_voertuigcategorie_toevoeging, taxi_indicator,
      brandstoffen, diesel, gasoline, electric, count(*) as count from passages group by all)""",
)
def vehicle_profile(spark, sf_dir):
    return profiles.vehicle_profile(passages(spark, sf_dir))


@check(
    "day_span",
    """select cast(min(passage_at) as date) as first_day, cast(max(passage_at) as date) as last_day
    from passages""",
)
def day_span(spark, sf_dir):
    return answers.day_span(spark, in_batches(spark, sf_dir))


@check(
    "rows_per_day",
    "select cast(passage_at as date) as passage_date, count(*) as count from passages group by all",
)
def rows_per_day(spark, sf_dir):
    return profiles.rows_per_day(with_day(passages(spark, sf_dir)))


# ------------------------------------------------------------------- exports

SQL_TOTALS = """select camera_id, camera_naam,
    {bucket} as bucket, cast(sum(count) as bigint) as sum
    from (select *, date_trunc('hour', passage_at) as hour_start, 1 as count from passages)
    where {days} group by all"""
_SQL_BUCKET = "cast(hour_start as timestamp)"
_SQL_YEAR_WEEK = "extract(year from passage_at) = 2000 and extract(week from passage_at) = 12"


@check("export_hourly", SQL_TOTALS.format(bucket=_SQL_BUCKET, days=_SQL_YEAR_WEEK))
def export_hourly(spark, sf_dir):
    hours = traffic.passage_hour(passages(spark, sf_dir))
    return export.hourly_totals(hours, year=2000, week=12)


_SQL_LAST_WEEK = "cast(passage_at as date) between date '2000-03-27' and date '2000-04-02'"


@check("export_last_week", SQL_TOTALS.format(bucket=_SQL_BUCKET, days=_SQL_LAST_WEEK))
def export_last_week(spark, sf_dir):
    hours = traffic.passage_hour(passages(spark, sf_dir))
    return export.hourly_totals(hours, today=date(2000, 4, 5))


@check(
    "export_hourly_csv",
    SQL_TOTALS.format(
        bucket="strftime(hour_start, '%Y-%m-%d %H:%M:%S')",
        days="extract(year from passage_at) = 2000",
    ).replace("cast(sum(count) as bigint)", "cast(sum(count) as varchar)"),
)
def export_hourly_csv(spark, sf_dir):
    path = scratch_path(spark, "export")
    hours = traffic.passage_hour(passages(spark, sf_dir))
    write_hourly_csv(export.hourly_totals(hours, year=2000), path)
    return spark.read.option("header", True).csv(path)


_SQL_RECORD_ID = (
    "(select concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) from (select"
    " md5(concat_ws('|', passage_id, cast(volgnummer as varchar), cast(passage_at as varchar)))"
    " as h))"
)
_SQL_DELIVERED = [
    c
    for c in export.DELIVERY_COLUMNS
    if c not in ("id", "camera_locatie", "kenteken_karakters_betrouwbaarheid", "extra_data")
]
_SQL_FROM_CAMERAS = """from passages where
    cast(passage_at as date) between date '2000-03-01' and date '2000-10-30'
    and camera_id in (select camera_id from cameras where cordon in ('S100', 'A10'))"""


def delivered(spark, sf_dir):
    wanted = cameras(spark, sf_dir).filter(F.col("cordon").isin("S100", "A10"))
    return export.camera_delivery(
        passages(spark, sf_dir, fuels_as_text=False), wanted, date(2000, 3, 1), date(2000, 10, 30)
    )


@check(
    "camera_delivery",
    f"""select {_SQL_RECORD_ID} as id, {', '.join(_SQL_DELIVERED)}, punt_x, punt_y,
    cast(null as varchar) as extra_data, cast(passage_at as date) as passage_date
    {_SQL_FROM_CAMERAS}""",
)
def camera_delivery(spark, sf_dir):
    rows = points(delivered(spark, sf_dir), "camera_locatie")
    return rows.withColumn("brandstoffen", F.to_json("brandstoffen")).drop(
        "kenteken_karakters_betrouwbaarheid"
    )


@check(
    "camera_delivery_csv",
    f"""select {_SQL_RECORD_ID} as id, {', '.join(
        f"cast({c} as varchar) as {c}"
        for c in _SQL_DELIVERED if c != 'automatisch_verwerkbaar'
    )}, if(automatisch_verwerkbaar, 't', 'f') as automatisch_verwerkbaar,
    format('SRID=4326;POINT({{}} {{}})', cast(punt_x as varchar), cast(punt_y as varchar))
    as camera_locatie, cast(null as varchar) as kenteken_karakters_betrouwbaarheid,
    cast(null as varchar) as extra_data, cast(passage_at as date) as passage_date
    {_SQL_FROM_CAMERAS}""",
)
def camera_delivery_csv(spark, sf_dir):
    path = scratch_path(spark, "delivery")
    write_delivery_csv(delivered(spark, sf_dir), path)
    text = ", ".join(f"{name} string" for name in export.DELIVERY_COLUMNS)
    return (
        spark.read.schema(f"{text}, {PASSAGE_DAY} date")
        .option("sep", ";")
        .option("escape", '"')
        .csv(path)
    )


# ------------------------------------------------------------------- refresh


@check(
    "refresh_day",
    SQL_PASSAGE_HOUR.format(
        days="""cast(passage_at as date) <> date '2000-03-26'
        and (cast(passage_at as date) <> date '2000-03-27' or kenteken_land = 'NL')"""
    ),
)
def refresh_day(spark, sf_dir):
    """All days, then one day again with fewer rows and one with none."""
    path = scratch_path(spark, "passage-hour")
    rows = passages(spark, sf_dir)
    after = date(2000, 12, 1)
    refresh.refresh("passage_hour", rows, {}, path, after, date(1999, 12, 31))
    home = rows.filter("kenteken_land = 'NL'")
    refresh.refresh("passage_hour", home, {}, path, date(2000, 3, 28))
    before = filters.in_utc_days(rows, date(1999, 12, 31), date(2000, 1, 3))
    refresh.refresh("passage_hour", before, {}, path, date(2000, 3, 27))
    return refresh.read_table(spark, path, "passage_hour")


@check(
    "backfill",
    SQL_HEAVY_HOUR.format(
        days="cast(local_at as date) between date '2000-03-26' and date '2000-10-30'"
    ),
)
def backfill(spark, sf_dir):
    path = scratch_path(spark, "heavy-hour")
    rows = passages(spark, sf_dir, fuels_as_text=False)
    lookups = {"cameras": cameras(spark, sf_dir)}
    today, start = date(2000, 10, 31), date(2000, 3, 26)
    refresh.refresh("heavy_hour", rows, lookups, path, today, start)
    table = points(refresh.read_table(spark, path, "heavy_hour"), "camera_locatie")
    return table.withColumn("brandstoffen", F.to_json("brandstoffen"))


@check(
    "refresh_trailing",
    SQL_TAXI.format(
        days="cast(passage_at as date) between date '2000-10-28' and date '2000-10-30'"
    ),
)
def refresh_trailing(spark, sf_dir):
    path = scratch_path(spark, "taxi-hour")
    rows, lookups = passages(spark, sf_dir), {"areas": areas(spark, sf_dir)}
    refresh.refresh("taxi_hour", rows, lookups, path, date(2000, 10, 31))
    return refresh.read_table(spark, path, "taxi_hour")


# Rows of a file that come before one they should follow.
SORTED = {"passage_hour": ("date", "camera_id", "hour"), "igor_hour": ("passage_at_date", "passage_at_hour")}


@check(
    "refresh_order",
    f"""select 'passage_hour' as table_name, date as day, count(*) as rows, cast(0 as bigint) as late
    from ({SQL_PASSAGE_HOUR.format(days="true")}) group by date
    union all
    select 'igor_hour', passage_at_date, count(*), 0 from ({SQL_IGOR}) group by passage_at_date""",
)
def refresh_order(spark, sf_dir):
    """Every file of a refreshed table holds its rows in the table's order."""
    rows, lookups = passages(spark, sf_dir), {"cameras": cameras(spark, sf_dir)}
    found = []
    for name, (day, *keys) in SORTED.items():
        path = scratch_path(spark, name)
        refresh.refresh(name, rows, lookups, path, date(2000, 12, 1), date(1999, 12, 31))
        in_file = Window.partitionBy("file").orderBy("at")
        now = F.struct(day, *keys)
        stored = spark.read.parquet(path).select(
            F.col(day).alias("day"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("at"),
            now.alias("now"),
        )
        late = F.lag("now").over(in_file) > F.col("now")
        found.append(
            stored.withColumn("late", F.coalesce(late, F.lit(False)))
            .groupBy("day")
            .agg(F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late"))
            .withColumn("table_name", F.lit(name))
        )
    return reduce(DataFrame.unionByName, found)


# ----------------------------------------------------------------- streaming

# Columns that follow from the natural key alone.
KEYED = ["passage_id", "volgnummer", "passage_at", "camera_id", "voertuig_soort"]


@check(
    "stream_ingest",
    f"""select distinct {SQL_ID} as passage_id, volgnummer, passage_at, camera_id,
    voertuig_soort from passages where {SQL_VALID}""",
)
def stream_ingest(spark, sf_dir):
    root = scratch_path(spark, "stream")
    lines = nested_lines(spark, sf_dir).write.option("compression", "gzip")
    lines.option("maxRecordsPerFile", FILE_ROWS).text(f"{root}/in")
    start_ingest(
        {"v2": spark.readStream.text(f"{root}/in")},
        f"{root}/passages",
        f"{root}/invalid",
        f"{root}/duplicates",
        f"{root}/checkpoint",
        now=NOW,
    ).awaitTermination()
    return read_passages(spark, f"{root}/passages").select(*KEYED)


# Rows of a file that a stream reads.
FILE_ROWS = 500_000


def streamed(spark, sf_dir, root, *parts):
    """The passages as a stream of several micro-batches, in the order of ``parts``:
    conditions on the line items, a third of them each.  Every part has as many files as
    a micro-batch takes, at least two."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    files = max(2, -(-lineitem.count() // (3 * FILE_ROWS)))
    for number, part in enumerate(parts):
        lineitem.filter(part).repartition(files).write.mode("append").parquet(f"{root}/in")
        if number + 1 < len(parts):
            time.sleep(1.1)  # the file source orders by modification time
    reader = spark.readStream.schema(lineitem.schema).option("maxFilesPerTrigger", files)
    return passages_of(reader.parquet(f"{root}/in"))


# Parts of the line items that each hold all days, and the same by season, latest
# first: every later micro-batch is months behind the one before.
SCATTERED = [f"l_partkey % 3 = {n}" for n in range(3)]
BACKWARDS = ["l_orderkey % 12 >= 8", "l_orderkey % 12 between 4 and 7", "l_orderkey % 12 < 4"]


@check("stream_dedup", f"select distinct {', '.join(KEYED)} from passages")
def stream_dedup(spark, sf_dir):
    """Every passage comes twice, the copies in later micro-batches."""
    root = scratch_path(spark, "stream")
    rows = streamed(spark, sf_dir, root, *SCATTERED, *SCATTERED[:2])
    start_storing(rows, f"{root}/passages", f"{root}/checkpoint").awaitTermination()
    return read_passages(spark, f"{root}/passages").select(*KEYED)


@check("stream_late_rows", f"select distinct {', '.join(KEYED)} from passages")
def stream_late_rows(spark, sf_dir):
    root = scratch_path(spark, "stream")
    rows = streamed(spark, sf_dir, root, *BACKWARDS)
    start_storing(rows, f"{root}/passages", f"{root}/checkpoint").awaitTermination()
    return read_passages(spark, f"{root}/passages").select(*KEYED)


# A key is stored once, so a repeated one counts once.
SQL_STORED_ONCE = """select distinct passage_id, volgnummer, passage_at, camera_id, camera_naam
    from passages"""


def stream_counts(spark, sf_dir, length, parts):
    root = scratch_path(spark, "stream")
    rows = streamed(spark, sf_dir, root, *parts)
    places = [f"{root}/{name}" for name in ("passages", "counts", "checkpoint")]
    start_counts(rows, *places, length).awaitTermination()
    return read_counts(spark, f"{root}/counts")


@check(
    "stream_hour_counts",
    f"""select cast(date_trunc('hour', passage_at) as timestamp) as window_start, camera_id,
    camera_naam, count(*) as count from ({SQL_STORED_ONCE}) group by all""",
)
def stream_hour_counts(spark, sf_dir):
    return stream_counts(spark, sf_dir, "hour", SCATTERED)


@check(
    "stream_minute_counts",
    f"""select cast(date_trunc('minute', passage_at) as timestamp) as window_start, camera_id,
    camera_naam, count(*) as count from ({SQL_STORED_ONCE}) group by all""",
)
def stream_minute_counts(spark, sf_dir):
    return stream_counts(spark, sf_dir, "minute", BACKWARDS)


# ------------------------------------------------------------------- quality

_CHECKED_AT = datetime(2000, 11, 1, 1, 30)


@check(
    "check_freshness",
    """select newest, date_diff('second', newest, timestamp '2000-11-01 01:30:00') as age_seconds,
    if(timestamp '2000-11-01 01:30:00' - newest < interval 1 hour, 'ok', 'stale') as status
    from (select max(created_at) as newest from passages)""",
)
def check_freshness(spark, sf_dir):
    return answers.freshness(spark, in_batches(spark, sf_dir), _CHECKED_AT)


@check(
    "check_volume",
    "select count(*) as row_count, count(*) >= 20000 as enough from passages",
)
def check_volume(spark, sf_dir):
    return answers.volume(spark, in_batches(spark, sf_dir))


@check(
    "missing_days",
    """select cast(day as date) as passage_date
    from generate_series(timestamp '1999-12-25', timestamp '2000-12-31', interval 1 day) g(day)
    where cast(day as date) not in (select cast(passage_at as date) from passages)""",
)
def missing_days(spark, sf_dir):
    table = in_batches(spark, sf_dir)
    return answers.missing_days(spark, table, date(1999, 12, 25), date(2000, 12, 31))


def sql_violations(table: str, rows: str, broken: dict[str, str]) -> str:
    parts = [
        f"select '{table}' as table_name, '{rule}' as rule,"
        f" count(*) filter ({test}) as violations from ({rows})"
        for rule, test in broken.items()
    ]
    return " union all ".join(parts)


@check(
    "check_constraints",
    sql_violations(
        "igor_hour",
        SQL_IGOR,
        {
            "kenteken_land:required": "kenteken_land is null",
            "richting:length": "length(richting) > 3",
        },
    )
    + " union all "
    + sql_violations(
        "heavy_cordon_hour",
        SQL_CORDON_HOUR,
        {
            "kenteken_land:required": "kenteken_land is null",
            "richting:length": "length(richting) > 3",
        },
    )
    + " union all "
    + sql_violations(
        "taxi_hour",
        SQL_TAXI.format(days="true"),
        {
            f"{c}:required": f"{c} is null"
            for c in (
                "hh",
                "gebiedstype",
                "gebied",
                "electric",
                "unieke_passages",
                "check_on_camera_count",
            )
        },
    )
    + " union all "
    + sql_violations(
        "passage_hour",
        SQL_PASSAGE_HOUR.format(days="true"),
        {
            f"{c}:required": f"{c} is null"
            for c in ("camera_id", "camera_naam", "rijrichting", "camera_kijkrichting")
        },
    ),
)
def check_constraints(spark, sf_dir):
    rows = passages(spark, sf_dir)
    reports = {
        "igor_hour": quality.constraint_report(
            traffic.igor_hour(rows, cameras(spark, sf_dir)), quality.CORDON_HOUR_RULES
        ),
        "heavy_cordon_hour": quality.constraint_report(
            traffic.heavy_cordon_hour(rows, cameras(spark, sf_dir)), quality.CORDON_HOUR_RULES
        ),
        "taxi_hour": quality.constraint_report(
            taxi.taxi_hour(rows, areas(spark, sf_dir)), quality.TAXI_HOUR_RULES
        ),
        "passage_hour": quality.constraint_report(
            traffic.passage_hour(rows), quality.PASSAGE_HOUR_RULES
        ),
    }
    named = [df.withColumn("table_name", F.lit(name)) for name, df in reports.items()]
    return reduce(DataFrame.unionByName, named)
