"""ebbgraph plans."""
