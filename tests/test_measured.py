"""What tasks read and shuffle, from Spark's event log of a session of its own."""

import json
import os
import subprocess
import sys

import pytest

from tests import measure_jobs as jobs


@pytest.fixture(scope="module")
def measured(tmp_path_factory):
    scratch = tmp_path_factory.mktemp("measured")
    done = subprocess.run(
        [sys.executable, os.path.abspath(jobs.__file__), str(scratch)], capture_output=True, text=True, timeout=600,
        env={k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")},
    )
    assert done.returncode == 0, done.stderr[-3000:]
    return json.loads(done.stdout.strip().splitlines()[-1])


def test_a_sample_takes_two_scans(measured):
    assert measured["notes"]["sample"] == jobs.SAMPLE
    # one that counts, one that keeps; the rest is what was kept
    assert measured["phases"]["sample"]["records"] < 2 * jobs.ROWS + 5 * jobs.SAMPLE


def test_a_cutoff_takes_two_scans(measured):
    assert measured["phases"]["cutoff"]["records"] < 2.2 * jobs.ROWS
    assert measured["phases"]["cutoff"]["shuffled"] < jobs.ROWS / 20  # only the bracket is ordered


def test_layouts_take_the_heads_of_files(measured):
    assert measured["notes"]["layouts"] == [3, 3]
    assert measured["phases"]["headers"]["bytes"] <= jobs.FILES * 64 * 1024


def test_stored_rows_stay_where_they_are(measured):
    assert measured["notes"]["new"] == jobs.ARRIVED // 2
    # the batch is shuffled twice (repeats, then buckets) and its count once; 60,000 stored rows are not
    assert measured["phases"]["against stored"]["shuffled"] < 2.5 * jobs.ARRIVED
    assert "Broadcast" not in measured["notes"]["plan"]


def test_a_wide_column_costs_what_a_number_costs(measured):
    """No split-finding task reads more for a text column of 5,000 values than for a number of as many bins as all have."""
    assert measured["notes"]["values wide"] > 4_000
    number, wide = (measured["phases"][name]["most_fetched"] for name in ("number", "wide"))
    assert 0 < wide < 1.5 * number
