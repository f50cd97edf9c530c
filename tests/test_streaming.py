from pyspark.sql import functions as F

from corvane.catalog import QUERIES


def test_streamed_windows_are_all_windows(spark):
    """The windows within an hour of the last event are there too."""
    d = "/root/testdata/sf0.001"
    rows = lambda q: sorted(map(tuple, QUERIES[q](spark, d).select("window_start", "event_type", "n", F.round("total", 4)).collect()))
    got = rows("event_windows_streamed")
    assert len(got) > 0 and got == rows("event_windows")
