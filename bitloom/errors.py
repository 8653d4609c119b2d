"""The kinds of failure this engine reports."""

from __future__ import annotations


class BitloomError(Exception):
    """Base of all errors raised on purpose."""


class StorageError(BitloomError):
    """Reading or writing failed."""


class FrameError(BitloomError):
    """A table does not have the shape an operator needs."""


class DataLoadError(BitloomError):
    """A source could not be loaded."""


class ImageError(BitloomError):
    """An image could not be decoded or encoded."""


class BitLengthMismatch(BitloomError):
    """A bit pattern has another length than its layout."""


class MissingSample(BitloomError):
    """A row that was asked for does not exist."""


class InvalidBaseId(BitloomError):
    """A row points to a base that is not in the base table."""


class InvalidMetadata(BitloomError):
    """Metadata contradict each other."""


class InvalidFeatureSpec(BitloomError):
    """A feature's transform cannot represent its values."""


class InvalidDataType(BitloomError):
    """A column's type is not supported."""
