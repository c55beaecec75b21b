"""ebbgraph sources."""
