"""Operators for preparing training text: licence scans, sharding, near-duplicates, toxicity, decontamination, HTML, chat, nearest neighbours, BPE, substring dedup.

Each operator is a module with a general function on DataFrames; ``queries.py`` registers the thin ``opN_<name>`` queries.
Nothing outside this subpackage imports it.
"""
