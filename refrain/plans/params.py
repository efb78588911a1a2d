"""The dials of detection."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items beyond the outermost vote that verification still looks at, bits of a seed key, items of another width.
MARGIN = 48
KEY_BITS = 16


@dataclass(frozen=True)
class DetectParams:
    """Defaults are those of 32-bit audio items; ``scaled`` gives them for another width."""

    bits: int = 32
    max_bit_err: int = 8
    min_seconds: float = 5.0
    min_shows: int = 2
    max_gap_seconds: float = 0.5
    min_density: float = 0.5
    top_offsets: int = 8
    locate_min_ratio: float = 0.55
    dedupe_ratio: float = 0.6
    seed_max_bucket: int = 48
    seed_min_votes: int = 3
    seed_max_spread: int = 40

    def __post_init__(self) -> None:
        # with one show every position would count as recurring
        if self.min_shows < 2:
            raise ValueError("min_shows must be 2 or more")

    def scaled(self, bits: int) -> DetectParams:
        """For items of another width; only the tolerated bits change."""
        return self if bits == self.bits else replace(self, bits=bits, max_bit_err=max(1, round(self.max_bit_err * bits / self.bits)))

    def bit_err(self, bits: Column) -> Column:
        """Tolerated bits for a column of widths."""
        other = F.greatest(F.lit(1), F.rint(F.lit(self.max_bit_err) * bits / self.bits).cast("int"))
        return F.when(bits == self.bits, F.lit(self.max_bit_err)).otherwise(other)

    def min_items(self, item_sec: Column) -> Column:
        """Items of the shortest segment."""
        return F.greatest(F.lit(1), F.rint(F.lit(self.min_seconds) / item_sec).cast("int"))

    def max_gap_items(self, item_sec: Column) -> Column:
        """Uncovered items bridged within a segment."""
        return F.greatest(F.lit(0), F.rint(F.lit(self.max_gap_seconds) / item_sec).cast("int"))
