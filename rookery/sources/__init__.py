"""Schemas, table loading, sinks and the derivation of social tables from star-schema data."""
