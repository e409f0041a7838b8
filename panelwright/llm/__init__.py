"""Training-data pipeline operators: text dedup, decontamination, tokenisation, quality, LM scoring.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries and their SQL.
"""
