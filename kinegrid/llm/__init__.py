"""Operators of a training-data pipeline: packing, deduplication, language ID, token stores, archives and scoring.

Nothing outside this subpackage imports it; ``queries`` registers its queries.
"""
