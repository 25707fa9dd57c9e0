"""A driver-side cache with expiry for small results, and the keys and lifetimes of what it holds."""

from __future__ import annotations

import fnmatch
import time
from collections.abc import Callable
from typing import Any

LIFETIMES = {"robots": 3600, "query": 300, "posting": 600}


def cache_key(kind: str, name: str) -> str:
    return f"{kind}:{name}"


class Cache:
    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self._clock, self._held = clock, {}

    def _alive(self, key: str) -> bool:
        if key in self._held and (end := self._held[key][1]) is not None and self._clock() >= end:
            del self._held[key]
        return key in self._held

    def set(self, key: str, value: Any, ttl: float | None = None) -> None:
        self._held[key] = (value, None if ttl is None else self._clock() + ttl)

    def get(self, key: str) -> Any:
        return self._held[key][0] if self._alive(key) else None

    def exists(self, key: str) -> bool:
        return self._alive(key)

    def delete(self, *keys: str) -> int:
        found = [k for k in set(keys) if self._alive(k)]
        for k in found:
            del self._held[k]
        return len(found)

    def expire(self, key: str, ttl: float) -> bool:
        if not self._alive(key):
            return False
        self.set(key, self._held[key][0], ttl)
        return True

    def ttl(self, key: str) -> int:
        """Whole seconds left; -1 without expiry, -2 for a missing key."""
        if not self._alive(key):
            return -2
        end = self._held[key][1]
        return -1 if end is None else round(end - self._clock())

    def mset(self, values: dict[str, Any]) -> None:
        for key, value in values.items():
            self.set(key, value)

    def mget(self, keys: list[str]) -> list:
        return [self.get(k) for k in keys]

    def incr(self, key: str, by: int = 1) -> int:
        value = int(self.get(key) or 0) + by
        end = self._held[key][1] if self._alive(key) else None
        self._held[key] = (value, end)
        return value

    def keys(self, pattern: str = "*") -> list[str]:
        return sorted(k for k in list(self._held) if self._alive(k) and fnmatch.fnmatchcase(k, pattern))

    def delete_pattern(self, pattern: str) -> int:
        return self.delete(*self.keys(pattern))

    def clear(self) -> None:
        self._held.clear()

    def size(self) -> int:
        return len(self.keys())

    def ping(self) -> bool:
        return True

    def get_or_set(self, key: str, ttl: float | None, make: Callable[[], Any]) -> Any:
        if not self._alive(key):
            self.set(key, make(), ttl)
        return self.get(key)
