"""Training-data operators: counting, search, packing, language ID, archives, deduplication, decontamination, LM scoring.

Nothing outside this package imports it. ``registry`` holds its queries.
"""
