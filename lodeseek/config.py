"""Settings from the environment, with defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    index_path: str = "/data/index"
    pages_path: str = "/data/pages"
    blob_path: str = "/data/blobs"
    crawl_rate_limit: int = 5
    max_depth: int = 3
    user_agent: str = "LodeseekBot/1.0"
    seed_urls: str = ""

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        """INDEX_PATH, PAGES_PATH and so on; a number that is none keeps its default."""
        env, found = os.environ if env is None else env, {}
        for f in fields(cls):
            value = env.get(f.name.upper())
            if value is None:
                continue
            if isinstance(f.default, int):
                if not value.strip().lstrip("+-").isdigit():
                    continue
                found[f.name] = int(value)
            else:
                found[f.name] = value
        return cls(**found)
