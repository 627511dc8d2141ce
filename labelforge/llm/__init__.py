"""Training-data operators: archives, mixing, fingerprints, quality, tokens, toxicity, language, near copies, personal data.

Nothing outside this subpackage imports it; `queries.py` holds the queries it adds to the entry file.
"""
