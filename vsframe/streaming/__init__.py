"""Streaming.

The reference is batch only: it has no stream source, sink, watermark, time
window or state, so nothing streaming-specific is built here. The operators in
``vsframe.operators`` are plain DataFrame transformations; those made only of
filters, projections, ``inline`` and aggregates (``alias_filter``,
``from_period``, ``either_side``, ``two_sided_to_long``,
``net_by_counterparty``, ``repeated_in_group``, ``count_per_group``) also
accept a streaming DataFrame, with an aggregate needing ``complete`` or
``update`` output mode (checked by ``tests/test_streaming.py`` with a file
stream and the in-process memory sink). The rank, lag and top-k operators are
batch only.
"""
