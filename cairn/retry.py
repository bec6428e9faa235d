"""Retries of driver-side I/O: full jitter under a doubling cap."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TypeVar

from cairn.errors import Kind, is_retryable, kind_of

T = TypeVar("T")


@dataclass
class Policy:
    attempts: int = 5
    base: float = 0.1
    most: float = 10.0
    throttled_factor: float = 3.0
    rng: random.Random = field(default_factory=random.Random)
    sleep: Callable[[float], None] = time.sleep

    def delay(self, attempt: int, throttled: bool) -> float:
        """A random wait below ``base * 2**attempt`` (more when throttled), capped."""
        try:
            cap = self.base * 2.0**attempt * (self.throttled_factor if throttled and self.throttled_factor > 0 else 1)
        except OverflowError:
            cap = self.most
        return self.rng.random() * max(0.0, min(cap, self.most))

    def run(self, op: Callable[[], T]) -> T:
        """Call ``op`` until it succeeds, fails for good, or has used up its attempts."""
        for attempt in range(max(1, self.attempts)):
            try:
                return op()
            except Exception as e:
                if not is_retryable(e) or attempt + 1 >= self.attempts:
                    raise
                self.sleep(self.delay(attempt, kind_of(e) is Kind.THROTTLED))
        raise AssertionError("unreachable")
