from __future__ import annotations

import json
import os

import pytest

from tests.test_ingest import FLAT
from wayside.jobs import main
from wayside.sources.passages import read_passages


def test_from_payloads_to_export(spark, folder):
    def job(*words):
        return main([w.format(folder) for w in (*words, "--zone", "Europe/Brussels")], spark)

    os.mkdir(folder + "/in")
    with open(folder + "/in/a.json", "w") as out:
        for n in range(3):
            taxi = {"taxiIndicator": True, "electric": 1, "toegestaneMaximumMassaVoertuig": 9000}
            out.write(json.dumps({**FLAT, **taxi, "volgnummer": n}) + "\n")
    with open(folder + "/areas.csv", "w") as out:
        out.write("id,gebiedstype,gebied,camera_id\n1,Stadsbreed,Stad,ANPR-01001\n")
    stored = ["--passages", "{0}/passages"]
    rejects = ["--invalid", "{0}/invalid", "--duplicates", "{0}/duplicates"]
    ingest = ["ingest", "--v1", "{0}/in", *stored, *rejects, "--now", "2024-03-12T09:30:00"]
    with pytest.raises(SystemExit, match="label"):
        job(*ingest)
    assert job(*ingest, "--batch", "monday") == "ingest finished"
    assert job(*ingest, "--batch", "monday") == "batch monday was finished before"
    today = ["--today", "2024-03-13"]
    assert job("refresh", *stored, "--table", "passage_hour", "--output", "{0}/hours", *today) == (
        "1 rows, cleared 0 days"
    )
    taxi = ["refresh", *stored, "--table", "taxi_hour", "--output", "{0}/taxi", *today]
    assert job(*taxi, "--areas", "{0}/areas.csv") == "1 rows, cleared 0 days"
    with pytest.raises(FileNotFoundError, match="never loaded"):
        job(*taxi, "--helpers", "{0}/helpers")
    assert job("load", "--table", "taxi_areas", "--csv", "{0}/areas.csv", "--helpers",
               "{0}/helpers") == "1 rows"
    os.remove(folder + "/areas.csv")
    assert job(*taxi, "--helpers", "{0}/helpers") == "1 rows, cleared 0 days"
    assert job("export", "--hours", "{0}/hours", "--output", "{0}/csv", "--year",
               "2024") == "1 rows"
    masses = lambda: {r.toegestane_maximum_massa_voertuig for r in read_passages(spark, folder + "/passages").collect()}
    before = masses()
    job("rewrite-history", *stored)
    assert masses() == before == {9000}
    job("deliver", *stored, "--output", "{0}/delivery", "--camera", "cam-1", "--first",
        "2024-03-01", "--last", "2024-03-31")
    assert spark.read.csv(folder + "/delivery", sep=";").count() == 3
    with pytest.raises(SystemExit, match="only 3 rows"):
        job("check", *stored, "--now", "2024-03-12T10:00:00")
