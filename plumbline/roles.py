"""Column roles: which columns of a table are key, group, target and features."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    row_id: str = "row_id"
    group: str = "grp"
    target: str = "y"
    score: str = "score"
    keys: tuple[str, ...] = ("row_id",)
    categorical: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()

    @property
    def features(self) -> tuple[str, ...]:
        return (*self.categorical, *self.numeric)


def require(condition: bool, message: str) -> None:
    """Raise ``ValueError`` when a parameter is out of range."""
    if not condition:
        raise ValueError(message)
