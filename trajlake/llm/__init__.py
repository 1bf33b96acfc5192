"""Training-data operators: mixing, formatting, fingerprints, BPE, dedup, licences, WARC, quality.

Self-contained: nothing outside this package imports it.
"""
