"""ebbgraph streaming."""
