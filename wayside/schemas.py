"""Declared schemas.  Nothing is inferred from data.

Column names and lengths are fixed values: results and payloads use them as is.
"""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

# What a list item holds besides its declared fields, as a JSON object in the order of
# its keys; NULL where there is nothing else.
REST = "rest"

CHARACTER_RELIABILITY = T.ArrayType(
    T.StructType(
        [
            T.StructField("positie", T.IntegerType()),
            T.StructField("betrouwbaarheid", T.IntegerType()),
            T.StructField(REST, T.StringType()),
        ]
    )
)

# One element per fuel.  The flat payload fills the first two fields only; keys
# inside list items keep their camelCase spelling.
FUELS = T.ArrayType(
    T.StructType(
        [
            T.StructField("brandstof", T.StringType()),
            T.StructField("volgnr", T.IntegerType()),
            T.StructField("volgnummer", T.IntegerType()),
            T.StructField("emissieklasse", T.StringType()),
            T.StructField("co2UitstootGecombineerd", T.DoubleType()),
            T.StructField("co2UitstootGewogen", T.DoubleType()),
            T.StructField("milieuklasseEgGoedkeuringZwaar", T.StringType()),
            T.StructField(REST, T.StringType()),
        ]
    )
)

_S, _I, _H, _D, _B = (
    T.StringType(),
    T.IntegerType(),
    T.ShortType(),
    T.DoubleType(),
    T.BooleanType(),
)

# The passage record.
PASSAGE = T.StructType(
    [
        T.StructField("passage_id", _S, False),
        T.StructField("passage_at", T.TimestampNTZType(), False),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField("volgnummer", _I, False),
        T.StructField("version", _S, False),
        T.StructField("straat", _S),
        T.StructField("rijrichting", _H),
        T.StructField("rijstrook", _H),
        T.StructField("camera_id", _S),
        T.StructField("camera_naam", _S),
        T.StructField("camera_kijkrichting", _D),
        T.StructField("camera_locatie", POINT),
        T.StructField("kenteken_land", _S),
        T.StructField("kenteken_nummer_betrouwbaarheid", _H),
        T.StructField("kenteken_land_betrouwbaarheid", _H),
        T.StructField("kenteken_karakters_betrouwbaarheid", CHARACTER_RELIABILITY),
        T.StructField("indicatie_snelheid", _D),
        T.StructField("automatisch_verwerkbaar", _B),
        T.StructField("voertuig_soort", _S),
        T.StructField("merk", _S),
        T.StructField("inrichting", _S),
        T.StructField("datum_eerste_toelating", T.DateType()),
        T.StructField("datum_tenaamstelling", T.DateType()),
        T.StructField("toegestane_maximum_massa_voertuig", _I),
        T.StructField("europese_voertuigcategorie", _S),
        T.StructField("europese_voertuigcategorie_toevoeging", _S),
        T.StructField("taxi_indicator", _B),
        T.StructField("maximale_constructie_snelheid_bromsnorfiets", _H),
        T.StructField("brandstoffen", FUELS),
        T.StructField("extra_data", _S),
        T.StructField("diesel", _H),
        T.StructField("gasoline", _H),
        T.StructField("electric", _H),
        T.StructField("versit_klasse", _S),
        T.StructField("kenteken_hash", _S),
        T.StructField("massa_ledig_voertuig", _I),
        T.StructField("aantal_assen", _H),
        T.StructField("aantal_staanplaatsen", _H),
        T.StructField("aantal_wielen", _H),
        T.StructField("aantal_zitplaatsen", _H),
        T.StructField("handelsbenaming", _S),
        T.StructField("lengte", _H),
        T.StructField("breedte", _H),
        T.StructField("maximum_massa_trekken_ongeremd", _I),
        T.StructField("maximum_massa_trekken_geremd", _I),
        T.StructField("co2_uitstoot_gecombineerd", _D),
        T.StructField("co2_uitstoot_gewogen", _D),
        T.StructField("milieuklasse_eg_goedkeuring_zwaar", _S),
    ]
)

# The key a passage may be stored under once.
NATURAL_KEY = ["passage_id", "volgnummer", "passage_at"]

# Partition column of the stored table: the UTC day of ``passage_at``.
PASSAGE_DAY = "passage_date"

# Columns that may not be NULL after ingest (``created_at`` is
# stamped by the job, ``volgnummer`` has a default).
REQUIRED = ["passage_id", "passage_at", "volgnummer", "version"]

# Longest text allowed per column.
MAX_LENGTH = {
    "version": 20,
    "straat": 255,
    "camera_id": 255,
    "camera_naam": 255,
    "kenteken_land": 2,
    "voertuig_soort": 64,
    "merk": 255,
    "inrichting": 255,
    "europese_voertuigcategorie": 2,
    "europese_voertuigcategorie_toevoeging": 1,
    "versit_klasse": 255,
    "kenteken_hash": 255,
    "handelsbenaming": 255,
    "milieuklasse_eg_goedkeuring_zwaar": 255,
}

# Inclusive numeric bounds beyond those of the type.
VALUE_RANGE = {
    "volgnummer": (0, 2147483647),
    "kenteken_nummer_betrouwbaarheid": (0, 1000),
    "kenteken_land_betrouwbaarheid": (0, 1000),
}

CAMERA = T.StructType(
    [
        T.StructField("camera_id", _S),
        T.StructField("vma_linknr", _S),
        T.StructField("camera_naam", _S, False),
        T.StructField("rijrichting", _I),
        T.StructField("rijrichting_correct", _B),
        T.StructField("camera_kijkrichting", _D),
        T.StructField("order_kaart", _I),
        T.StructField("order_naam", _S),
        T.StructField("cordon", _S),
        T.StructField("richting", _S),
        T.StructField("location", POINT),
        T.StructField("geom", _S),
        T.StructField("azimuth", _D),
    ]
)

TAXI_AREA = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("gebiedstype", _S),
        T.StructField("gebied", _S),
        T.StructField("camera_id", _S),
    ]
)

# Payloads are read with every leaf as text, so that one badly typed field
# rejects its record with a reason instead of silently turning into NULL.


def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


# Items of payload lists are read with whatever keys they have.
_ITEMS = T.ArrayType(T.MapType(T.StringType(), T.StringType()))

# Flat payload in its camelCase spelling: ``id`` stands for ``passage_id`` and
# the location is a GeoJSON point.
PAYLOAD_V1 = T.StructType(
    _text(
        "id",
        "passageAt",
        "volgnummer",
        "version",
        "straat",
        "rijrichting",
        "rijstrook",
        "cameraId",
        "cameraNaam",
        "cameraKijkrichting",
    )
    + [
        T.StructField(
            "cameraLocatie",
            T.StructType(
                [
                    T.StructField("type", T.StringType()),
                    T.StructField("coordinates", T.ArrayType(T.StringType())),
                ]
            ),
        )
    ]
    + _text("kentekenLand", "kentekenNummerBetrouwbaarheid", "kentekenLandBetrouwbaarheid")
    + [T.StructField("kentekenKaraktersBetrouwbaarheid", _ITEMS)]
    + _text(
        "indicatieSnelheid",
        "automatischVerwerkbaar",
        "voertuigSoort",
        "merk",
        "inrichting",
        "datumEersteToelating",
        "datumTenaamstelling",
        "toegestaneMaximumMassaVoertuig",
        "europeseVoertuigcategorie",
        "europeseVoertuigcategorieToevoeging",
        "taxiIndicator",
        "maximaleConstructieSnelheidBromsnorfiets",
    )
    + [
        T.StructField("brandstoffen", _ITEMS)
    ]
    + _text(
        "extraData",
        "diesel",
        "gasoline",
        "electric",
        "versitKlasse",
        "kentekenHash",
        "massaLedigVoertuig",
        "aantalAssen",
        "aantalStaanplaatsen",
        "aantalWielen",
        "aantalZitplaatsen",
        "handelsbenaming",
        "lengte",
        "breedte",
        "maximumMassaTrekkenOngeremd",
        "maximumMassaTrekkenGeremd",
        "co2UitstootGecombineerd",
        "co2UitstootGewogen",
        "milieuklasseEgGoedkeuringZwaar",
    )
)

PAYLOAD_V2 = T.StructType(
    _text(
        "id",
        "volgnummer",
        "timestamp",
        "version",
        "automatischVerwerkbaar",
        "rijstrook",
        "rijrichting",
    )
    + [
        T.StructField(
            "camera",
            T.StructType(
                _text("id", "kijkrichting", "naam", "straat")
                + [T.StructField("locatie", T.StructType(_text("longitude", "latitude")))]
            ),
        ),
        T.StructField(
            "voertuig",
            T.StructType(
                [
                    T.StructField(
                        "kenteken",
                        T.StructType(
                            _text("kentekenHash", "landcode")
                            + [
                                T.StructField(
                                    "betrouwbaarheid",
                                    T.StructType(
                                        _text("landcodeBetrouwbaarheid", "kentekenBetrouwbaarheid")
                                        + [
                                            T.StructField(
                                                "karaktersBetrouwbaarheid", _ITEMS
                                            )
                                        ]
                                    ),
                                )
                            ]
                        ),
                    )
                ]
                + _text(
                    "indicatieSnelheid",
                    "jaarEersteToelating",
                    "toegestaneMaximumMassaVoertuig",
                    "europeseVoertuigcategorie",
                    "europeseVoertuigcategorieToevoeging",
                    "taxiIndicator",
                    "maximaleConstructiesnelheidBromSnorfiets",
                    "versitKlasse",
                    "massaLedigVoertuig",
                    "aantalAssen",
                    "aantalStaanplaatsen",
                    "aantalWielen",
                    "aantalZitplaatsen",
                    "handelsbenaming",
                    "lengte",
                    "breedte",
                    "maximumMassaTrekkenOngeremd",
                    "maximumMassaTrekkenGeremd",
                    "voertuigSoort",
                    "inrichting",
                    "merk",
                )
                + [
                    T.StructField("brandstoffen", _ITEMS)
                ]
            ),
        ),
    ]
)


# ------------------------------------------------------------------- aggregates


def _columns(*groups: tuple[T.DataType, str]) -> T.StructType:
    """Columns of several names per type, as ("type", "name name …")."""
    return T.StructType([T.StructField(n, kind) for kind, names in groups for n in names.split()])


_DATE, _L = T.DateType(), T.LongType()
_AT = (
    (_DATE, "passage_at_date"),
    (_I, "passage_at_year passage_at_month passage_at_day passage_at_week"),
    (_S, "passage_at_day_of_week"),
    (_I, "passage_at_hour"),
)
_STAMPED = ((T.TimestampNTZType(), "passage_at_timestamp"), *_AT)
_HEAVY_CAMERA = (
    (_S, "camera_id camera_naam"),
    (POINT, "camera_locatie"),
    (_D, "camera_kijkrichting"),
    (_H, "rijrichting"),
    (_S, "straat"),
    (_B, "rijrichting_correct"),
    (_S, "cordon"),
    (_I, "cordon_order_kaart"),
    (_S, "cordon_order_naam richting"),
)
_HEAVY_VEHICLE = (
    (_S, "kenteken_land voertuig_soort inrichting"),
    (_S, "europese_voertuigcategorie europese_voertuigcategorie_toevoeging"),
    (FUELS, "brandstoffen"),
    (_H, "diesel gasoline electric"),
    (_S, "massa_ledig_voertuig toegestane_maximum_massa_voertuig lengte breedte"),
    (_H, "aantal_staanplaatsen aantal_zitplaatsen"),
    (_S, "merk handelsbenaming"),
    (_L, "count"),
)

# The columns of the six aggregate tables, in their order.
AGGREGATES = {
    "passage_hour": _columns(
        (_DATE, "date"),
        (_I, "year month day week dow hour"),
        (_S, "camera_id camera_naam"),
        (_H, "rijrichting"),
        (_D, "camera_kijkrichting"),
        (_S, "kenteken_land voertuig_soort europese_voertuigcategorie"),
        (_B, "taxi_indicator"),
        (_H, "diesel gasoline electric"),
        (_S, "toegestane_maximum_massa_voertuig"),
        (_L, "count"),
    ),
    "heavy_cordon_hour": _columns(
        *_STAMPED,
        (_I, "order_kaart"),
        (_S, "order_naam cordon richting"),
        (POINT, "location"),
        (_S, "geom"),
        (_D, "azimuth"),
        (_S, "kenteken_land voertuig_soort inrichting voertuig_klasse_toegestaan_gewicht"),
        (_L, "intensiteit"),
    ),
    "heavy_hour": _columns(*_AT, *_HEAVY_CAMERA, *_HEAVY_VEHICLE),
    "heavy_minute": _columns(
        *_AT, (_I, "passage_at_minute"), *_HEAVY_CAMERA, (_S, "kenteken_hash"), *_HEAVY_VEHICLE
    ),
    "igor_hour": _columns(
        *_STAMPED,
        (_S, "camera_id camera_naam vma_linknr"),
        (_I, "order_kaart"),
        (_S, "order_naam cordon richting"),
        (POINT, "location"),
        (_S, "geom"),
        (_D, "azimuth"),
        (_S, "kenteken_land"),
        (_B, "taxi_indicator"),
        (_S, "europese_voertuigcategorie"),
        (_L, "intensiteit"),
    ),
    "taxi_hour": _columns(
        (_DATE, "passage_at_date"),
        (_I, "hh"),
        (_S, "gebiedstype gebied"),
        (_H, "electric"),
        (_L, "unieke_passages check_on_camera_count"),
    ),
}
