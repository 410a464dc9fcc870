"""Operators of a training-data pipeline: deduplication, filters, tokenisation, sharding.

Nothing outside this subpackage imports it.  Each module holds one operator with
a general interface; ``queries`` binds the operators to the tables of the driver.
"""
