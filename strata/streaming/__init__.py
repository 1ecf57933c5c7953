"""Streaming.

The surveyed project has no data stream: its only "stream" is a series of
progress events sent while the feature search runs.  Here that is the
``on_round`` callback of :func:`strata.operators.search.search_features`,
called on the driver after each round with the round's log row; no
Structured Streaming query is needed for it.  The run-log tables written
by :func:`strata.plans.runs.write_run` are plain parquet folders, so a
``spark.readStream`` over them can follow runs as they are appended.
"""
