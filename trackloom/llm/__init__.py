"""Training-data operators: archives, decontamination, extraction, near-duplicates,
token counts, personal data, packing, URL filters and quality ranking.

Nothing outside this subpackage imports it.
"""
