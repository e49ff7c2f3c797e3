"""Operators of a training-data pipeline: classify, deduplicate, decontaminate, mix and shard text."""
