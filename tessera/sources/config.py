"""The generation config: a small TOML file with fixed keys."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass
from pathlib import Path

MOST_BYTES = 1 << 20


@dataclass(frozen=True)
class GenerationConfig:
    config_version: int = 1
    adapter: str = "ai2thor"
    scene_names: tuple[str, ...] = ()
    split: str = "train"
    campaign_id: str = ""
    seed: int = 20260723
    width: int = 640
    height: int = 480
    max_requests: int = 60

    def __post_init__(self) -> None:
        named = len(self.scene_names) >= 1 and all(isinstance(s, str) and s for s in self.scene_names)
        many = len(self.scene_names)
        if named:  # any order will do, and a name may repeat
            object.__setattr__(self, "scene_names", tuple(sorted(set(self.scene_names))))
        whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
        checks = {
            "config_version must be 1": self.config_version == 1 and whole(self.config_version),
            "adapter must be ai2thor, json or tables": self.adapter in ("ai2thor", "json", "tables"),
            "scene_names must be 1 to 32 names": named and many <= 32,
            "split must be train, validation or test": self.split in ("train", "validation", "test"),
            "campaign_id must be lower-case letters, digits, dots, dashes or underscores": isinstance(self.campaign_id, str) and re.fullmatch(r"[a-z0-9][a-z0-9._-]{0,127}", self.campaign_id) is not None,
            "seed must be a whole number": whole(self.seed),
            "width and height must be from 1 to 4096": whole(self.width) and whole(self.height) and 1 <= self.width <= 4096 and 1 <= self.height <= 4096,
            "max_requests must be from 1 to 1000": whole(self.max_requests) and 1 <= self.max_requests <= 1000,
        }
        if wrong := [k for k, ok in checks.items() if not ok]:
            raise ValueError("; ".join(wrong))


def load_generation_config(path: str | Path) -> GenerationConfig:
    """Reads a config; files that are not regular, have a second name (hard link), are too large or have other keys are refused."""
    path = Path(path)
    if not path.is_file() or path.is_symlink() or path.stat().st_nlink != 1:
        raise ValueError(f"not a regular file: {path}")
    if path.stat().st_size > MOST_BYTES:
        raise ValueError(f"larger than {MOST_BYTES} bytes: {path}")
    values = tomllib.loads(path.read_text("utf-8"))
    known = set(GenerationConfig.__dataclass_fields__)
    if extra := sorted(set(values) - known):
        raise ValueError(f"unknown keys: {', '.join(extra)}")
    if missing := sorted({"scene_names", "campaign_id"} - set(values)):
        raise ValueError(f"missing keys: {', '.join(missing)}")
    if not isinstance(values["scene_names"], list):
        raise ValueError("scene_names must be a list")
    return GenerationConfig(**(values | {"scene_names": tuple(values["scene_names"])}))
