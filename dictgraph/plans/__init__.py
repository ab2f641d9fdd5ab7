from dictgraph.plans.graph import edges_by_root, membership_relation, alias_map, orient
from dictgraph.plans.sizing import broadcast_if_bounded, is_bounded
from dictgraph.plans.lineage import cut_lineage, cut_lineage_counted

__all__ = [
    "edges_by_root",
    "membership_relation",
    "alias_map",
    "orient",
    "broadcast_if_bounded",
    "is_bounded",
    "cut_lineage",
    "cut_lineage_counted",
]
