"""Training-data operators: media, packing, WARC, HTML text, near-duplicates, mixing, URL rules, sharding, quality.

Each module holds one operator with a general interface; ``queries`` registers a thin query for each of them.
Nothing outside this subpackage imports it.
"""
