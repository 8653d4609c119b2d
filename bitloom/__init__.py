"""Compression and analytics by generalized deduplication, on Spark.

The names below are loaded when they are first used, so that workers import little.
"""

from __future__ import annotations

from importlib import import_module

_NAMES = {
    "Plan": "bitloom.plans.compress",
    "Compressed": "bitloom.plans.compress",
    "compress": "bitloom.plans.compress",
    "compress_normalized": "bitloom.plans.compress",
    "compress_batch": "bitloom.plans.compress",
    "Chain": "bitloom.plans.chain",
    "Options": "bitloom.operators.normalize",
    "normalize": "bitloom.operators.normalize",
    "reconstruct": "bitloom.operators.normalize",
    "bit_scores": "bitloom.operators.entropy",
    "ExactCounter": "bitloom.operators.distinct",
    "HyperLogLogCounter": "bitloom.operators.distinct",
    "select": "bitloom.operators.selection",
    "condense": "bitloom.operators.condense",
    "Layout": "bitloom.operators.basetable",
    "load_csv": "bitloom.operators.ingest",
    "Source": "bitloom.operators.ingest",
    "ImageInfo": "bitloom.operators.images",
    "DatasetInfo": "bitloom.schema",
    "Feature": "bitloom.schema",
    "BitloomError": "bitloom.errors",
    "init_logging": "bitloom.timing",
    "timed": "bitloom.timing",
}
__all__ = sorted(_NAMES)


def __getattr__(name: str):
    if name not in _NAMES:
        raise AttributeError(name)
    return getattr(import_module(_NAMES[name]), name)
