from __future__ import annotations

import json
from datetime import date, datetime

from wayside.operators import dedup
from wayside.operators.dedup import (
    already_stored,
    first_of_key,
    later_copies,
    not_stored,
    same_days,
)
from wayside.operators.export import list_json
from wayside.operators.ingest import accepted, read_validated, rejected, to_passages
from wayside.plans import ingest as plan_of_ingest
from wayside.plans.ingest import ingest_batch
from wayside.sources.passages import append_passages, read_passages

ID = "6a8b2c4d-0000-4000-8000-000000000001"
FLAT = {
    "id": ID,
    "passageAt": "2024-03-12T10:15:30.250+01:00",
    "volgnummer": 2,
    "version": "passage-v1",
    "straat": " Kade ",
    "rijstrook": 3,
    "rijrichting": -1,
    "cameraId": "cam-1",
    "cameraNaam": "ANPR-01001-A - Rijstrook -1",
    "cameraKijkrichting": 90.5,
    "cameraLocatie": {"type": "Point", "coordinates": [4.8, 52.3]},
    "kentekenLand": "NL",
    "kentekenNummerBetrouwbaarheid": 640,
    "kentekenLandBetrouwbaarheid": 1000,
    "kentekenKaraktersBetrouwbaarheid": [{"positie": 1, "betrouwbaarheid": 650}],
    "indicatieSnelheid": 66.5,
    "automatischVerwerkbaar": True,
    "voertuigSoort": "PeRsonEnaUto",
    "merk": "Merk",
    "inrichting": "hatchback",
    "datumEersteToelating": "2015-03-06",
    "datumTenaamstelling": "2016-03-06",
    "toegestaneMaximumMassaVoertuig": 3000,
    "europeseVoertuigcategorie": "M1",
    "europeseVoertuigcategorieToevoeging": "G",
    "taxiIndicator": False,
    "brandstoffen": [{"brandstof": "Diesel", "volgnr": 1}],
    "extraData": {"a": [1]},
    "diesel": 1,
}
NESTED = {
    "id": ID,
    "volgnummer": 1,
    "timestamp": "2024-03-12T09:15:30Z",
    "version": "passage-v2",
    "automatischVerwerkbaar": True,
    "rijstrook": 1,
    "rijrichting": "NAAR",
    "camera": {
        "id": "cam-1",
        "kijkrichting": 10.0,
        "naam": "naam",
        "straat": "Kade",
        "locatie": {"longitude": 4.8, "latitude": 52.3},
    },
    "voertuig": {
        "kenteken": {
            "kentekenHash": "abc",
            "landcode": "BE",
            "betrouwbaarheid": {
                "landcodeBetrouwbaarheid": 1,
                "kentekenBetrouwbaarheid": 2,
                "karaktersBetrouwbaarheid": [{"positie": 1, "betrouwbaarheid": 3}],
            },
        },
        "indicatieSnelheid": 12.5,
        "jaarEersteToelating": 1999,
        "toegestaneMaximumMassaVoertuig": 18000,
        "europeseVoertuigcategorie": "N3",
        "europeseVoertuigcategorieToevoeging": "G",
        "taxiIndicator": False,
        "maximaleConstructiesnelheidBromSnorfiets": 25,
        "versitKlasse": "v",
        "massaLedigVoertuig": 8000,
        "aantalAssen": 2,
        "aantalStaanplaatsen": 0,
        "aantalWielen": 6,
        "aantalZitplaatsen": 3,
        "handelsbenaming": "truck",
        "lengte": 900,
        "breedte": 240,
        "maximumMassaTrekkenOngeremd": 10,
        "maximumMassaTrekkenGeremd": 20,
        "voertuigSoort": "Bedrijfsauto",
        "inrichting": "bak",
        "merk": "Merk",
        "brandstoffen": [
            {"naam": "Benzine", "volgnummer": 1, "emissieklasse": "6", "co2UitstootGewogen": 5.5},
            {"naam": "Elektriciteit", "volgnummer": 2},
        ],
    },
}
NOW = datetime(2024, 3, 12, 12)


def lines(spark, *payloads):
    text = [(p if isinstance(p, str) else json.dumps(p),) for p in payloads]
    return spark.createDataFrame(text, "value string")


def stored(spark, version, payload):
    return to_passages(read_validated(lines(spark, payload), version), NOW).collect()


def reasons(spark, version, payload):
    found = rejected(read_validated(lines(spark, payload), version)).collect()
    return set(found[0].failed_rules) if found else set()


def test_flat_payload(spark):
    (row,) = stored(spark, "v1", FLAT)
    assert row.passage_id == ID and row.volgnummer == 2
    assert row.passage_at == datetime(2024, 3, 12, 9, 15, 30, 250000)
    assert row.created_at == NOW
    assert row.straat == "Kade" and row.rijrichting == -1
    assert (row.camera_locatie.x, row.camera_locatie.y) == (4.8, 52.3)
    assert row.kenteken_karakters_betrouwbaarheid[0].asDict() == {
        "positie": 1, "betrouwbaarheid": 650, "rest": None
    }
    assert row.brandstoffen[0].brandstof == "Diesel" and row.diesel == 1
    assert json.loads(row.extra_data) == {"a": [1]}
    # masks
    assert row.inrichting == "Personenauto" and row.merk is None
    assert row.toegestane_maximum_massa_voertuig == 1500
    assert row.europese_voertuigcategorie_toevoeging is None
    assert row.datum_eerste_toelating == date(2015, 1, 1) and row.datum_tenaamstelling is None


def test_flat_payload_in_snake_case_and_without_optional_fields(spark):
    payload = {"id": ID, "passage_at": "2024-03-12T09:15:30Z", "version": "passage-v1",
               "camera_naam": "x"}
    (row,) = stored(spark, "v1", payload)
    assert row.volgnummer == 1 and row.camera_naam == "x" and row.brandstoffen is None


def test_other_keys_of_list_items_are_kept(spark):
    items = [{"brandstof": "Diesel", "b": 2, "andereSleutel": "x"}, {"brandstof": "Diesel"}]
    (row,) = stored(spark, "v1", {**FLAT, "brandstoffen": items})
    assert [fuel.rest for fuel in row.brandstoffen] == ['{"andereSleutel":"x","b":"2"}', None]
    vehicle = {**NESTED["voertuig"], "brandstoffen": [{"naam": "Benzine", "nieuw": True}]}
    (row,) = stored(spark, "v2", {**NESTED, "voertuig": vehicle})
    assert (row.brandstoffen[0].brandstof, row.brandstoffen[0].rest) == ("Benzine", '{"nieuw":"true"}')


def test_a_number_given_as_null_is_not_an_absent_one(spark):
    assert reasons(spark, "v1", {**FLAT, "volgnummer": None}) == {"volgnummer:required"}


def test_items_leave_with_their_other_keys(spark):
    items = [{"brandstof": "Diesel", "nieuw": "x"}, {"andere": "y"}, {"volgnr": 2}]
    passages = to_passages(read_validated(lines(spark, {**FLAT, "brandstoffen": items}), "v1"), NOW)
    (row,) = passages.select(list_json(passages["brandstoffen"]).alias("text")).collect()
    assert json.loads(row.text) == items


def test_numbers_may_come_as_text(spark):
    (row,) = stored(spark, "v1", {**FLAT, "rijstrook": "4", "kentekenLandBetrouwbaarheid": 12.0})
    assert row.rijstrook == 4 and row.kenteken_land_betrouwbaarheid == 12


FLAT_REJECTS = [
    ({"kentekenKaraktersBetrouwbaarheid": [{"positie": "abc"}]},
     "kenteken_karakters_betrouwbaarheid:type"),
    ({"brandstoffen": [{"brandstof": "Diesel", "volgnr": "first"}]}, "brandstoffen:type"),
    ({"kentekenNummerBetrouwbaarheid": -1}, "kenteken_nummer_betrouwbaarheid:range"),
    ({"kentekenLandBetrouwbaarheid": 1001}, "kenteken_land_betrouwbaarheid:range"),
    ({"volgnummer": -1}, "volgnummer:range"),
    ({"kentekenLand": "NLD"}, "kenteken_land:length"),
    ({"rijstrook": 40000}, "rijstrook:type"),
    ({"rijstrook": 1.5}, "rijstrook:type"),
    ({"id": "no"}, "passage_id:type"),
    ({"passageAt": "yesterday"}, "passage_at:type"),
    ({"datumEersteToelating": "2020-13-01"}, "datum_eerste_toelating:type"),
    ({"taxiIndicator": "maybe"}, "taxi_indicator:type"),
    ({"cameraLocatie": {"type": "Point", "coordinates": [1]}}, "camera_locatie:type"),
    ({"version": None}, "version:required"),
]


def check_rejects(spark, version, valid, cases):
    """All broken variants and one valid payload in one batch."""
    variants = [
        json.dumps({k: v for k, v in {**valid, **change}.items() if v is not None})
        for change, _ in cases
    ]
    validated = read_validated(lines(spark, *variants, valid), version).cache()
    found = {row.payload: set(row.failed_rules) for row in rejected(validated).collect()}
    assert accepted(validated).count() == 1
    validated.unpersist()
    return [found[text] for text in variants]


def test_flat_rejects(spark):
    found = check_rejects(spark, "v1", FLAT, FLAT_REJECTS)
    assert found == [{reason} for _, reason in FLAT_REJECTS]


def test_all_reasons_are_given_and_the_payload_is_kept(spark):
    payload = json.dumps({"id": "no", "version": "passage-v1"})
    (row,) = rejected(read_validated(lines(spark, payload), "v1")).collect()
    assert set(row.failed_rules) == {"passage_id:type", "passage_at:required"}
    assert row.payload == payload
    assert "payload:malformed" in reasons(spark, "v1", "{not json")


def test_time_without_offset_is_local(spark):
    (row,) = stored(spark, "v1", {**FLAT, "passageAt": "2024-07-01T12:00:00"})
    assert row.passage_at == datetime(2024, 7, 1, 10)
    (row,) = stored(spark, "v1", {**FLAT, "passageAt": "2024-07-01T12:00:00+0200"})
    assert row.passage_at == datetime(2024, 7, 1, 10)


def test_nested_payload(spark):
    (row,) = stored(spark, "v2", NESTED)
    assert row.version == "passage-v2" and row.rijrichting == -1
    assert row.passage_at == datetime(2024, 3, 12, 9, 15, 30)
    assert (row.camera_locatie.x, row.camera_locatie.y) == (52.3, 4.8)
    assert (row.kenteken_hash, row.kenteken_land) == ("abc", "BE")
    assert (row.kenteken_land_betrouwbaarheid, row.kenteken_nummer_betrouwbaarheid) == (1, 2)
    assert row.kenteken_karakters_betrouwbaarheid[0].betrouwbaarheid == 3
    assert (row.diesel, row.gasoline, row.electric) == (0, 1, 1)
    assert row.datum_eerste_toelating == date(1999, 1, 1)
    assert row.maximale_constructie_snelheid_bromsnorfiets == 25
    fuel = row.brandstoffen[0]
    assert (fuel.brandstof, fuel.volgnummer, fuel.emissieklasse) == ("Benzine", 1, "6")
    assert fuel.co2UitstootGewogen == 5.5 and row.co2_uitstoot_gewogen is None
    assert (row.lengte, row.breedte, row.aantal_wielen) == (900, 240, 6)
    assert (row.maximum_massa_trekken_ongeremd, row.maximum_massa_trekken_geremd) == (10, 20)
    assert row.merk == "Merk" and row.straat == "Kade"


def test_nested_payload_with_required_fields_only(spark):
    payload = {"id": ID, "volgnummer": 1, "timestamp": "2024-03-12T09:15:30Z",
               "camera": {"id": "cam-1"}, "voertuig": {}}
    (row,) = stored(spark, "v2", payload)
    given = {"passage_id", "volgnummer", "passage_at", "created_at", "version", "camera_id"}
    rest = {k: v for k, v in row.asDict().items() if k not in given}
    assert rest.pop("brandstoffen") == []
    assert set(rest.values()) == {None}


NESTED_REJECTS = [
    ({"voertuig": {"brandstoffen": [{"naam": "Diesel", "volgnummer": "x"}]}}, "brandstoffen:type"),
    ({"rijrichting": "OOST"}, "rijrichting:type"),
    ({"camera": {"naam": "x"}}, "camera_id:required"),
    ({"volgnummer": None}, "volgnummer:required"),
    ({"voertuig": None}, "voertuig:required"),
    ({"voertuig": {"jaarEersteToelating": 12345}}, "datum_eerste_toelating:type"),
    ({"voertuig": {"brandstoffen": [{"volgnummer": 1}]}}, "brandstoffen:required"),
]


def test_nested_rejects(spark):
    found = check_rejects(spark, "v2", NESTED, NESTED_REJECTS)
    assert all(reason in got for (_, reason), got in zip(NESTED_REJECTS, found))


def test_first_copy_wins_and_the_rest_is_reported(make_passages):
    same = {"passage_id": ID}
    rows = [
        {**same, "created_at": datetime(2024, 3, 12, 11), "straat": "second"},
        {**same, "created_at": datetime(2024, 3, 12, 10), "straat": "first"},
        {**same, "created_at": datetime(2024, 3, 12, 11), "straat": "second"},
        {**same, "passage_at": datetime(2024, 3, 12, 10, 15, 31), "straat": "other time"},
        {**same, "volgnummer": 2, "straat": "other number"},
    ]
    df = make_passages(*rows)
    assert {r.straat for r in first_of_key(df).collect()} == {"first", "other time", "other number"}
    assert first_of_key(df).columns == df.columns
    assert [(r.straat, r.copies) for r in later_copies(df).collect()] == [("second", 2)]


def test_hot_key_stays_whole(spark, make_passages):
    """A third of all rows are copies of one key; nothing is lost or added."""
    hot = make_passages({"passage_id": ID, "straat": "hot"}).crossJoin(spark.range(500)).drop("id")
    cold = make_passages(*[{} for _ in range(1000)])
    df = hot.unionByName(cold)
    assert first_of_key(df).count() == 1001
    assert [r.copies for r in later_copies(df).collect()] == [499]


def test_against_history(spark, make_passages, folder):
    rows = make_passages(*[{} for _ in range(6)])
    append_passages(rows.filter("passage_id < '00000000-0000-0000-0000-000000000002'"), folder + "/t")
    history = same_days(read_passages(spark, folder + "/t"), rows)
    assert same_days(read_passages(spark, folder + "/t"), rows.limit(0)).count() == 0
    assert not_stored(rows, history).count() == 4
    assert already_stored(rows, history).count() == 2


def test_batch_can_be_repeated(spark, folder):
    other = {**FLAT, "id": ID[:-1] + "2"}
    broken = {**FLAT, "id": "no"}
    batch = lines(spark, FLAT, FLAT, other, broken)
    paths = [f"{folder}/{name}" for name in ("passages", "invalid", "duplicates")]

    def counts():
        return [spark.read.parquet(path).count() for path in paths]

    ingest_batch({"v1": batch}, *paths, batch=0, now=NOW)
    assert counts() == [2, 1, 1]
    ingest_batch({"v1": batch}, *paths, batch=0, now=NOW)
    assert counts() == [2, 1, 1]
    ingest_batch({"v1": lines(spark, FLAT)}, *paths, batch=1, now=NOW)
    assert counts() == [2, 1, 2]


def _batches(spark, folder, name):
    """A batch, and one with its keys again and others, each key twice."""
    root = f"{folder}/{name}"
    paths = [f"{root}/{part}" for part in ("passages", "invalid", "duplicates")]
    copies = [{**FLAT, "volgnummer": n, "merk": m} for n in range(1, 5) for m in ("A", "B", "B")]
    ingest_batch({"v1": lines(spark, *copies[:6])}, *paths, batch=0, now=NOW)
    ingest_batch({"v1": lines(spark, *copies)}, *paths, batch=1, now=NOW)
    stored = read_passages(spark, paths[0]).select("volgnummer", "merk")
    repeats = spark.read.parquet(paths[2]).select("batch", "volgnummer", "merk", "copies")
    return [sorted(map(tuple, df.collect())) for df in (stored, repeats)]


def test_many_repeated_keys_of_a_batch_are_shuffled_once(spark, folder, monkeypatch):
    few = _batches(spark, folder, "few")
    assert [n for n, _ in few[0]] == [1, 2, 3, 4]

    def many(passages, max_repeated=None):
        return dedup.repeated_and_hot(passages, 0)

    monkeypatch.setattr(plan_of_ingest, "repeated_and_hot", many)
    monkeypatch.setattr(plan_of_ingest, "firsts_given", None)
    monkeypatch.setattr(plan_of_ingest, "later_given", None)
    assert _batches(spark, folder, "many") == few


def test_a_new_batch_is_not_read_for_its_digest_alone(spark, folder, monkeypatch):
    paths = [f"{folder}/{part}" for part in ("passages", "invalid", "duplicates")]
    batch = {"v1": lines(spark, FLAT)}
    with monkeypatch.context() as patch:
        patch.setattr(plan_of_ingest, "content_digest", None)
        assert ingest_batch(batch, *paths, batch=0, now=NOW)
    assert not ingest_batch(batch, *paths, batch=0, now=NOW)
