"""The tunables of a drift query."""

from __future__ import annotations

from dataclasses import dataclass

# Two-sided 95 % points of Student's t for 0 to 30 degrees of freedom, and beyond.
T_95 = [
    0.0, 12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
    2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
]
T_BEYOND = 1.96


@dataclass(frozen=True)
class Settings:
    min_books: int = 4
    min_books_ranked: int = 2
    min_unstable_top50: int = 1
    anchors: int = 75
    centre: int = 100
    stable_rank: int = 50
    unstable_rank: int = 100
    comparative: int = 5
    pool: int = 100
    max_books: int = 16


DEFAULT = Settings()
#: For small vocabularies.
SMALL = Settings(min_books=3, anchors=20, centre=30, stable_rank=10, unstable_rank=30, pool=30)
