"""Training-data operators: mixing, BPE, near and exact duplicates, WARC, toxicity, HTML text, sharding, language.

Nothing else in the library imports this subpackage; its queries and their SQL are in ``queries``.
"""
