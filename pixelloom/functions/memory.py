"""How many tiles to filter at once: plain arithmetic on what a worker may use. Spark's own settings bound everything else."""

from __future__ import annotations

from dataclasses import dataclass

#: Megabytes that a tile costs at least, and the least and most tiles of a batch.
LEAST_TILE_MB, LEAST_BATCH, MOST_BATCH = 30.0, 5, 500


@dataclass(frozen=True)
class MemoryBudget:
    """Memory for tiles. An explicit batch wins over max_mb, that over a share of what is there, that over all of it."""

    detected_mb: float
    margin: float = 0.2
    share: float | None = None
    max_mb: float | None = None
    batch: int | None = None

    def __post_init__(self):
        if self.detected_mb <= 0 or not 0 <= self.margin < 1 or (self.share is not None and not 0 < self.share <= 1):
            raise ValueError("memory must be positive, the margin in [0, 1) and the share in (0, 1]")

    @property
    def usable_mb(self) -> float:
        if self.max_mb is not None:
            return min(self.max_mb, self.detected_mb)
        return self.detected_mb * (1 - self.margin) * (self.share if self.share is not None else 1.0)

    def batch_size(self, peaks_mb: list[float] = ()) -> int:
        """Tiles at once, given the peak use that was measured for some tiles."""
        if self.batch is not None:
            return max(1, self.batch)
        each = max(LEAST_TILE_MB, *peaks_mb, 0.0) if peaks_mb else LEAST_TILE_MB
        return int(max(LEAST_BATCH, min(MOST_BATCH, self.usable_mb // each)))
