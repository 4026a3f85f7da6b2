"""Passages, cameras and taxi areas derived from ``lineitem`` and ``supplier``.

One expression text serves both engines; only the tokens of ``DIALECT`` differ.
Every line item is one passage and every supplier one camera, so both tables
grow with the data.  Times fall into three four-day windows (turn of the year,
spring and autumn clock change) and six hours around the day edges, so groups
hold several rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.schemas import PASSAGE

DIALECT = {
    "spark": {
        "BASE": "timestamp_ntz '1999-12-31 00:00:00'",
        "ADD": "timestampadd(SECOND, cast({n} as int), {ts})",
        "SHORT": "smallint",
    },
    "duckdb": {
        "BASE": "timestamp '1999-12-31 00:00:00'",
        "ADD": "{ts} + to_seconds({n})",
        "SHORT": "smallint",
    },
}

_SECONDS = (
    "86400*(l_orderkey % 4 + case when l_orderkey % 12 >= 8 then 302"
    " when l_orderkey % 12 >= 4 then 85 else 0 end)"
    " + 3600*(case cast(l_quantity as int) % 6 when 0 then 0 when 1 then 1 when 2 then 2"
    " when 3 then 7 when 4 then 22 else 23 end)"
    " + (l_orderkey*7919 + l_linenumber*104729 + l_partkey*31) % 3600"
)


def camera_name(number: str, direction: str) -> str:
    return (
        f"concat('ANPR-', lpad(cast({number} as string), 9, '0'),"
        f" '-A - Rijstrook ', case when {direction} = 1 then '1' else '-1' end)"
    )


_DIRECTION = "case when l_linenumber % 2 = 0 then 1 else -1 end"


def passage_columns(dialect: str) -> dict[str, str]:
    d = DIALECT[dialect]
    return {
        "passage_id": (
            "md5(concat(cast(l_orderkey as string), '-', cast(l_partkey as string), '-',"
            " cast(l_suppkey as string)))"
        ),
        "volgnummer": "l_linenumber",
        "passage_at": d["ADD"].format(ts=d["BASE"], n=f"({_SECONDS})"),
        "created_at": d["ADD"].format(ts=d["BASE"], n=f"({_SECONDS} + l_partkey % 7200)"),
        "version": "'passage-v2'",
        "straat": "concat('Straat ', cast(l_suppkey as string))",
        "rijrichting": f"cast({_DIRECTION} as smallint)",
        "rijstrook": "cast(l_linenumber as smallint)",
        "camera_id": "concat('cam-', cast(l_suppkey as string))",
        "camera_naam": camera_name("l_suppkey", f"({_DIRECTION})"),
        "camera_kijkrichting": "cast((l_suppkey % 4) * 90 as double)",
        "kenteken_land": (
            "case when l_partkey % 13 = 0 then null when l_returnflag = 'R' then 'BE'"
            " else 'NL' end"
        ),
        "kenteken_nummer_betrouwbaarheid": "cast((l_partkey * 17) % 1100 as smallint)",
        "kenteken_land_betrouwbaarheid": "cast((l_partkey * 13) % 1001 as smallint)",
        "indicatie_snelheid": "l_quantity * 2.0",
        "automatisch_verwerkbaar": "l_linestatus = 'O'",
        "voertuig_soort": (
            "case l_partkey % 5 when 0 then 'Personenauto' when 1 then 'Bromfiets'"
            " when 2 then 'Bedrijfsauto' when 3 then 'Bus' end"
        ),
        "merk": "concat('Merk ', cast(l_partkey % 25 as string))",
        "inrichting": "concat('inr ', cast(l_partkey % 6 as string))",
        "datum_eerste_toelating": (
            "make_date(cast(1990 + l_partkey % 30 as int), cast(1 + l_partkey % 12 as int),"
            " cast(1 + l_partkey % 28 as int))"
        ),
        "datum_tenaamstelling": (
            "make_date(cast(2000 + l_partkey % 20 as int), cast(1 + l_partkey % 12 as int), 1)"
        ),
        "toegestane_maximum_massa_voertuig": (
            "case when l_partkey % 11 = 0 then null else cast(floor(l_extendedprice) as int) end"
        ),
        "europese_voertuigcategorie": (
            "case l_partkey % 5 when 0 then 'M1' when 1 then 'L1' when 2 then 'N1'"
            " when 3 then 'M3' else 'N3' end"
        ),
        "europese_voertuigcategorie_toevoeging": "case when l_partkey % 2 = 0 then 'G' end",
        "taxi_indicator": "case when l_partkey % 4 = 3 then null else l_partkey % 4 = 0 end",
        "brandstoffen": (
            "case l_partkey % 3 when 1 then '[{\"brandstof\":\"Elektriciteit\",\"volgnr\":1}]'"
            " when 2 then '[{\"brandstof\":\"Diesel\",\"volgnr\":1}]' end"
        ),
        "diesel": "cast(case l_partkey % 3 when 1 then 0 when 2 then 1 end as smallint)",
        "gasoline": "cast(l_partkey % 2 as smallint)",
        "electric": "cast(case l_partkey % 3 when 1 then 1 when 2 then 0 end as smallint)",
        "kenteken_hash": "md5(cast(l_orderkey % 5000 as string))",
        "massa_ledig_voertuig": "cast(floor(l_extendedprice / 2) as int)",
        "aantal_staanplaatsen": "cast(l_partkey % 30 as smallint)",
        "aantal_zitplaatsen": "cast(l_partkey % 60 as smallint)",
        "handelsbenaming": "concat('Model ', cast(l_partkey % 40 as string))",
        "lengte": (
            "cast(case when l_partkey % 9 = 0 then null else l_quantity * 40 end as smallint)"
        ),
        "breedte": (
            "cast(case when l_partkey % 7 = 0 then null else 137 + l_linenumber end as smallint)"
        ),
    }


# Passage point, as (x, y); not part of the flat column list above.
POINT_X = "cast(l_suppkey % 100 as double)"
POINT_Y = "cast(l_suppkey % 7 as double)"

# Every supplier gives a lane per direction; some are listed under a second
# viewing angle (counts twice where the angle is not joined on) and some under
# an outdated angle only (never found where it is).
CAMERA_COLUMNS = {
    "camera_id": "concat('cam-', cast(s_suppkey as string))",
    "vma_linknr": "concat('vma-', cast(s_suppkey % 50 as string))",
    "camera_naam": camera_name("s_suppkey", "r"),
    "rijrichting": "r",
    "rijrichting_correct": (
        "case when s_suppkey % 5 = 0 then false when s_suppkey % 5 = 1 then null else true end"
    ),
    "camera_kijkrichting": (
        "cast((s_suppkey % 4) * 90 + case when s_suppkey % 10 = 7 then e + 1 else e end as double)"
    ),
    "order_kaart": "cast(s_suppkey as int)",
    "order_naam": "concat('Punt ', cast(s_suppkey % 20 as string))",
    "cordon": (
        "case s_suppkey % 4 when 0 then 'S100' when 1 then 'A10' when 2 then 'Centrum' end"
    ),
    "richting": "case when r = 1 then 'uit' else 'in' end",
    "geom": "cast(null as string)",
    "azimuth": "cast((s_suppkey % 8) * 45 as double)",
}
CAMERA_X = "cast(s_suppkey % 90 as double)"
CAMERA_Y = "cast(s_suppkey % 11 as double)"

_DIRECTIONS = "(select 1 as r union all select -1 as r)"
_ANGLES = "case when s_suppkey % 10 = 2 then {list}(0, 45) else {list}(0) end"

# Three areas per supplier: one by name, one whose pattern holds a LIKE wildcard
# and one that is sometimes the empty pattern.
_AREAS = """
select s_suppkey, n, concat(cast(s_suppkey as string), '-', cast(n as string)) as id,
  case n when 0 then 'Stadsbreed' when 1 then 'Stadsdelen' else 'Interessant gebied' end
    as gebiedstype,
  case n when 0 then 'Stad' when 1 then concat('Deel ', cast(s_nationkey as string))
    else concat('Gebied ', cast(s_suppkey % 40 as string)) end as gebied,
  case when n = 0 then concat('ANPR-', lpad(cast(s_suppkey as string), 9, '0'))
    when n = 1 then concat('ANPR_', lpad(cast(s_suppkey as string), 9, '0'), '-A')
    when s_suppkey % 3 = 0 then ''
    else concat(lpad(cast(s_suppkey as string), 9, '0'), '-_ - Rijstrook') end as camera_id
from {source}
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages_of(lineitem: DataFrame, fuels_as_text: bool = False) -> DataFrame:
    """Passages with the full declared schema.  ``fuels_as_text`` keeps the fuel
    list as JSON text for comparison with SQL."""
    given = passage_columns("spark")
    columns = []
    for field in PASSAGE.fields:
        if field.name == "camera_locatie":
            column = F.struct(F.expr(POINT_X).alias("x"), F.expr(POINT_Y).alias("y"))
        elif field.name == "brandstoffen" and fuels_as_text:
            column = F.expr(given[field.name])
        elif field.name == "brandstoffen":
            column = F.from_json(F.expr(given[field.name]), field.dataType)
        elif field.name in given:
            column = F.expr(given[field.name]).cast(field.dataType)
        else:
            column = F.lit(None).cast(field.dataType)
        columns.append(column.alias(field.name))
    return lineitem.select(*columns)


def passages(spark: SparkSession, sf_dir: str, fuels_as_text: bool = True) -> DataFrame:
    return passages_of(_table(spark, sf_dir, "lineitem"), fuels_as_text)


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = (
        _table(spark, sf_dir, "supplier")
        .withColumn("r", F.explode(F.array(F.lit(1), F.lit(-1))))
        .withColumn("e", F.explode(F.expr(_ANGLES.format(list="array"))))
    )
    point = F.struct(F.expr(CAMERA_X).alias("x"), F.expr(CAMERA_Y).alias("y"))
    return suppliers.select(
        *[F.expr(text).alias(name) for name, text in CAMERA_COLUMNS.items()],
        point.alias("location"),
    )


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = _table(spark, sf_dir, "supplier").withColumn(
        "n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    )
    return spark.sql(_AREAS.format(source="{suppliers}"), suppliers=suppliers).drop(
        "s_suppkey", "n"
    )


def _listed(columns: dict[str, str]) -> str:
    return ",\n  ".join(f"{text} as {name}" for name, text in columns.items())


def with_tables(query: str) -> str:
    """DuckDB query text with the derived tables in front."""
    passages_sql = (
        f"select {_listed(passage_columns('duckdb'))},\n"
        f"  {POINT_X} as punt_x, {POINT_Y} as punt_y,\n"
        "  l_orderkey, l_partkey, l_suppkey, l_linenumber from lineitem"
    )
    suppliers = (
        f"(select s.*, d.r, unnest({_ANGLES.format(list='list_value')}) as e"
        f" from supplier s, {_DIRECTIONS} d)"
    )
    cameras_sql = (
        f"select {_listed(CAMERA_COLUMNS)}, {CAMERA_X} as punt_x, {CAMERA_Y} as punt_y,"
        f" s_suppkey from {suppliers}"
    )
    areas_sql = _AREAS.format(
        source="(select *, unnest(list_value(0, 1, 2)) as n from supplier)"
    )
    return (
        f"with passages as ({passages_sql}),\ncameras as ({cameras_sql}),\n"
        f"areas as ({areas_sql})\n{query}"
    )
