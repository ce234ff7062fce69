"""DataFrame -> DataFrame operators. None of them runs a Spark action."""

from vsframe.operators.counterparty import extremes, net_by_counterparty
from vsframe.operators.filters import alias_filter, either_side, from_period
from vsframe.operators.gaps import event_gaps, longest_gaps
from vsframe.operators.grouping import count_per_group, mode_per_group, repeated_in_group, top_n_per_group
from vsframe.operators.membership import member_set, restrict_to_members
from vsframe.operators.reshape import two_sided_to_long

__all__ = [
    "alias_filter",
    "count_per_group",
    "either_side",
    "event_gaps",
    "extremes",
    "from_period",
    "longest_gaps",
    "member_set",
    "mode_per_group",
    "net_by_counterparty",
    "repeated_in_group",
    "restrict_to_members",
    "top_n_per_group",
    "two_sided_to_long",
]
