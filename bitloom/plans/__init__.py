"""Chains of stages, and the plans that compress, read and analyse a table."""
