"""Code and document intelligence on Spark: index, search, graph and incremental maintenance as DataFrame plans."""
