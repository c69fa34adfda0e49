"""Operators of a training-data pipeline: packing, toxicity, SimHash
near-dedup, WARC, PII, quality rules, BPE, quotation linking, vantage-point
search and k-d sharding.  Nothing else in the library imports this package."""
