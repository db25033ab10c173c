"""Training-data operators: dedup, classification, mixing, formatting, PII, packing.

Nothing outside this subpackage imports it; ``tidewake.llm.queries`` registers
its queries and their SQL.
"""
