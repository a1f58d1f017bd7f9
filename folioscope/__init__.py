"""folioscope: document-retrieval analytics as lazy Spark plans."""
