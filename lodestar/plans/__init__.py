"""Session settings, the retrieval pipeline and the registered queries."""
