"""Attested-record analytics on Spark: DataFrame operators, column functions and registered queries."""
