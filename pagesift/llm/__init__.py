"""Training-data operators: sharding, language-model scoring, BPE, quality
rules, secret scans, near-duplicates, mixing, quality classifier, exact top-k
search and substring dedup.

Each module holds one operator with a general interface; ``queries`` binds
them to the test tables. Nothing outside this subpackage imports it.
"""
