"""Insecure data-flow analytics over very large tables of source code, on Spark."""
