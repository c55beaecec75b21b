"""ebbgraph functions."""
