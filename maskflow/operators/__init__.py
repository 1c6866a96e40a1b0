"""DataFrame operators: exact ranks, lookup picks, masks, generators, profiling, redaction."""
