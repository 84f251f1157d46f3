"""Training-data operators: cleaning, deduplication, tokenisation and formatting of text corpora.

Nothing else in the library imports this subpackage.
"""
