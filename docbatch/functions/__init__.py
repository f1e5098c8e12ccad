"""Part of docbatch."""
