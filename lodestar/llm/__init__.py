"""Training-data operators: cleaning, secrets, tokens, near duplicates, packing,
scoring, repeated passages, chat records, page text and benchmark leaks.

Each module holds one operator with a general interface; ``queries`` holds the
thin registered queries.  Nothing else in the library imports this subpackage.
"""
