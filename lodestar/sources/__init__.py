"""Tables, the chunk registry, corpora and stored indexes."""
