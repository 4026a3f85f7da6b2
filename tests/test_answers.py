"""Newest pages by days, and answers from the log."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest

from wayside.operators import profiles, quality
from wayside.operators.filters import by_attributes, newest
from wayside.plans import answers
from wayside.plans.ingest import store_new
from wayside.schemas import NATURAL_KEY
from wayside.sources.passages import append_passages, read_passages, stored_days

DAY = datetime(2024, 3, 1, 10)


@pytest.fixture(params=[True, False], ids=["log", "no log"])
def table(request, spark, make_passages, folder):
    """Days of very different size, with a gap, many rows of one time."""
    path = folder + "/passages"
    rows = [
        {"passage_at": DAY + timedelta(days=d, minutes=n // 3), "merk": "rare" if (d, n) == (0, 1) else "m"}
        for d, size in enumerate([30, 4, 0, 1, 0, 0, 9, 2])
        for n in range(size)
    ]
    for part in range(3):
        numbered = [
            {**r, "passage_id": f"{part}0000000-0000-0000-0000-{n:012d}"} for n, r in enumerate(rows) if n % 3 == part
        ]
        (store_new if request.param else append_passages)(make_passages(*numbered), path)
    return path


def keys(rows):
    return [tuple(r[k] for k in NATURAL_KEY) for r in rows]


def walked(spark, table, size, **criteria):
    pages, after = [], None
    while True:
        page = answers.newest_page(spark, table, size, after, **criteria).collect()
        pages.append(page)
        if len(page) < size:
            return pages
        after = {k: page[-1][k] for k in NATURAL_KEY}


@pytest.mark.parametrize("size", [1, 7, 100])
def test_pages_hold_all_rows_in_order(spark, table, size):
    pages = walked(spark, table, size)
    want = newest(read_passages(spark, table), 10_000).collect()
    assert keys(sum(pages, [])) == keys(want) and len(want) == 46


def test_pages_with_criteria(spark, table):
    assert len(sum(walked(spark, table, 9, merk="m"), [])) == 45
    found = answers.newest_page(spark, table, 5, merk="rare").collect()
    want = newest(by_attributes(read_passages(spark, table), merk="rare"), 5).collect()
    assert keys(found) == keys(want) and len(want) == 1


def days_read(page):
    return {p.split("passage_date=")[1][:10] for p in page.inputFiles()}


def test_a_page_reads_the_days_it_needs(spark, table):
    page = answers.newest_page(spark, table, 2)
    assert days_read(page) == {"2024-03-08"} and page.count() == 2
    third = answers.newest_page(spark, table, 9)
    assert days_read(third) == {"2024-03-08", "2024-03-07"} and third.count() == 9
    last = page.collect()[-1]
    following = answers.newest_page(spark, table, 9, {k: last[k] for k in NATURAL_KEY})
    assert days_read(following) == {"2024-03-08", "2024-03-07"} and following.count() == 9


def test_log_and_scan_give_the_same_answers(spark, table):
    rows, now = read_passages(spark, table), datetime(2024, 3, 12, 10, 20)
    first, last = date(2024, 2, 28), date(2024, 3, 20)
    for got, want in (
        (answers.freshness(spark, table, now), quality.freshness(rows, now)),
        (answers.day_span(spark, table), profiles.day_span(rows)),
        (answers.rows_per_day(spark, table), profiles.rows_per_day(rows)),
        (answers.volume(spark, table, 46), quality.volume(rows, 46)),
        (answers.missing_days(spark, table, first, last), quality.missing_days(rows, first, last)),
    ):
        assert got.dtypes == want.dtypes
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    assert len(stored_days(spark, table)) == 5


def test_answers_from_the_log_read_no_passages(spark, make_passages, folder):
    table = folder + "/passages"
    store_new(make_passages({}, {}), table)
    for frame in (answers.freshness(spark, table, DAY), answers.volume(spark, table)):
        assert frame.inputFiles() == []


def test_empty_table(spark, make_passages, folder):
    table = folder + "/passages"
    store_new(make_passages({}).limit(0), table)
    assert answers.newest_page(spark, table).count() == 0
    assert answers.freshness(spark, table, DAY).first().status == "empty"
    assert answers.volume(spark, table).first().row_count == 0
