"""Typed readers and writers, file listings and the TESTDATA adapters."""
