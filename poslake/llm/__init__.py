"""Training-data operators: packing, filters, deduplication, decontamination, sharding.

Nothing else in the library imports this subpackage.  Each module holds one operator with its own
general interface; ``queries`` holds the registered queries that apply them to whole tables.
"""
