"""Where indexes, vocabularies and models are read from and written to."""
