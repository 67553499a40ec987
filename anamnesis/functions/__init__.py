"""Part of the retrieval engine; see the modules."""
