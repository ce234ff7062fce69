"""vsframe: lazy Spark DataFrame operators for two-sided facts and event histories.

Every public operator takes DataFrames and returns a DataFrame without running
an action, so Catalyst sees one logical plan per query and can push filters,
prune columns and choose join strategies for the whole thing.
"""

from vsframe.functions import in_aliases, lenient, pair_label, period_predicate, truthy
from vsframe.operators import (
    count_per_group,
    either_side,
    alias_filter,
    event_gaps,
    extremes,
    from_period,
    longest_gaps,
    member_set,
    mode_per_group,
    net_by_counterparty,
    repeated_in_group,
    restrict_to_members,
    top_n_per_group,
    two_sided_to_long,
)
from vsframe.sources import apply_types, read_typed_csv, write_csv
from vsframe.session import shared_dir

__all__ = [
    "alias_filter",
    "apply_types",
    "count_per_group",
    "either_side",
    "event_gaps",
    "extremes",
    "from_period",
    "in_aliases",
    "lenient",
    "longest_gaps",
    "member_set",
    "mode_per_group",
    "net_by_counterparty",
    "pair_label",
    "period_predicate",
    "read_typed_csv",
    "repeated_in_group",
    "restrict_to_members",
    "shared_dir",
    "top_n_per_group",
    "truthy",
    "two_sided_to_long",
    "write_csv",
]
