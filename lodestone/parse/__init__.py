"""Source files to chunks and code-graph rows."""
