"""Code indexing over many repositories as Spark jobs: sources, symbols, call edges, comments, graph questions and streams."""
