"""Stages put one after the other: a stage is any callable from one value to the next."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Chain:
    """A pipeline; ``chain.then(f)`` makes a longer one."""

    stages: tuple[Callable[[Any], Any], ...] = ()

    def then(self, stage: Callable[[Any], Any]) -> Chain:
        return Chain((*self.stages, stage))

    def __call__(self, value: Any) -> Any:
        for stage in self.stages:
            value = stage(value)
        return value
