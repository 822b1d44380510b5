"""Training-data operators: personal data, deduplication, tokenising, quality, chats, mixing, page extraction.

Each module is one operator with a general interface; ``queries`` registers the thin ``opN_<name>`` queries.
Nothing outside this package imports it.
"""
