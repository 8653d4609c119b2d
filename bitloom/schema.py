"""Features, their invertible transforms, and the layout of bits over columns.

A normalised table has one BIGINT column per feature that holds an unsigned integer of
``bits`` bits (of 64 bits: the two's complement pattern).  A global bit number counts
through the features in order, least significant bit first.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import asdict, dataclass, field
from itertools import accumulate

from bitloom.errors import InvalidDataType, InvalidMetadata

#: Width and kind of the supported column types.
WIDTHS = {"int8": 8, "int16": 16, "int32": 32, "int64": 64, "uint8": 8, "uint16": 16, "uint32": 32, "uint64": 64, "uint128": 128, "float16": 16, "float32": 32, "float64": 64}
SPARK_TYPES = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "decimal(20,0)": "uint64"}
TO_SPARK = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double"}

#: Transform kinds.
NONE, SCALED, OFFSET_SIGNED, OFFSET_UNSIGNED, SCALED_OFFSET = "none", "scaled", "offset_signed", "offset_unsigned", "scaled_offset"


def bits_needed_nonzero(n: int) -> int:
    """Bits of an id below ``n``, one at least."""
    return max(1, (n - 1).bit_length()) if n > 0 else 1


def min_position_bits(n: int) -> int:
    """Bits to tell ``n`` positions apart; 0 for one or none."""
    return (n - 1).bit_length() if n > 1 else 0


def smallest_unsigned(most: int) -> int:
    """The smallest of 8, 16, 32, 64 and 128 bits that holds ``most``."""
    if most < 0 or most >> 128:
        raise InvalidDataType(f"no unsigned type holds {most}")
    return next(b for b in (8, 16, 32, 64, 128) if not most >> b)


def dtype_of(spark_type: str) -> str:
    """The engine's name of a Spark column type."""
    if spark_type not in SPARK_TYPES:
        raise InvalidDataType(f"unsupported dtype: {spark_type}")
    return SPARK_TYPES[spark_type]


@dataclass(frozen=True)
class Feature:
    """A column: name, original type, width, and how the original is had back from the unsigned value."""

    name: str
    dtype: str
    bits: int
    transform: str = NONE
    minimum: int = 0
    decimals: int = 0

    @property
    def mask(self) -> int:
        return (1 << self.bits) - 1


@dataclass
class DatasetInfo:
    """Features in order, the number of rows, and the weights of condensed rows if there are."""

    features: list[Feature]
    n: int
    weights: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.features:
            raise InvalidMetadata("a dataset needs a feature")
        self.offsets = [0, *accumulate(f.bits for f in self.features)]

    @property
    def chunk_size(self) -> int:
        return self.offsets[-1]

    @property
    def original_size_bits(self) -> int:
        return self.n * self.chunk_size

    def feature_of(self, bit: int) -> int:
        """Index of the feature a global bit belongs to."""
        if not 0 <= bit < self.chunk_size:
            raise InvalidMetadata(f"bit {bit} of {self.chunk_size}")
        return bisect_right(self.offsets, bit) - 1

    def place(self, bit: int) -> tuple[str, int]:
        """Column and local bit of a global bit."""
        f = self.feature_of(bit)
        return self.features[f].name, bit - self.offsets[f]

    def masks(self, bits: list[int]) -> dict[str, int]:
        """For each column the mask of those of ``bits`` that lie in it."""
        out = {f.name: 0 for f in self.features}
        for b in bits:
            name, local = self.place(b)
            out[name] |= 1 << local
        return out

    def to_dict(self) -> dict:
        return {"features": [asdict(f) for f in self.features], "n": self.n, "weights": self.weights}

    @classmethod
    def from_dict(cls, d: dict) -> DatasetInfo:
        return cls([Feature(**f) for f in d["features"]], d["n"], d["weights"])


def signed64(value: int) -> int:
    """An unsigned 64-bit value as the BIGINT of the same bits."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value
