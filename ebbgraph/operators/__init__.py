"""ebbgraph operators."""
