"""Streams of records: an addition, with nothing to be compared to."""
