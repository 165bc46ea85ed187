"""Operators of a training-data pipeline: deduplication, filters, packing, sharding and archives."""
