"""Growth and analysis of citation-style networks as Spark plans."""
