"""Bindings of every operator to the test tables, each with the equivalent SQL."""
