"""Training-data operators: scoring, tokenising, deduplicating, searching, packing and extracting.

Nothing outside this folder imports it, so it can be left out of a deployment as a whole.
"""
