"""Whole jobs: serving queries over the derived tables, demonstration inputs, and the registered queries."""
