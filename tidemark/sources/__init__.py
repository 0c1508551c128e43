"""Readers: stored tables, landed pages of feeds, the test tables' adapters."""
