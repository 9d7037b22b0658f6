"""Training-data operators: sharding, similarity joins, filters, formats and packing.

Nothing else in the library imports this subpackage; deleting it leaves the
vault, its queries and its tests working.
"""
