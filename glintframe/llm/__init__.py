"""Training-data operators: search, joins, filters, mixing, sharding, tokenizing.

Nothing outside this subpackage imports it.
"""
