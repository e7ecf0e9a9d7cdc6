"""Training-data operators: search, scans, tokenising, packing, language, toxicity and deduplication.

Nothing else in the library imports this subpackage. Each module holds one operator; ``queries`` registers the thin
``opN_<name>`` queries and their SQL.
"""
