"""Graph sources and sinks."""

from .graph import GraphStore, check_predicates, label_stats, max_vertex, read_dictionary, read_pairs, read_triples, write_partitioned

__all__ = ["GraphStore", "check_predicates", "label_stats", "max_vertex", "read_dictionary", "read_pairs", "read_triples", "write_partitioned"]
