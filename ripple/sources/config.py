"""Engine configuration: a TOML file in the repository, and environment settings of the optional labeler."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass
from pathlib import Path

from ..functions.rules import FAN_OUT

NAME = ".ripple.toml"


@dataclass(frozen=True)
class Config:
    fan_out: int = FAN_OUT
    captions: bool = False


def load(root: str | Path) -> Config:
    """fan_out_threshold (an integer of 1 or more, else 3) and [llm] captions, at the top level or below [ripple]; other keys are ignored."""
    path = Path(root) / NAME
    try:
        data = tomllib.loads(path.read_text())
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError):
        return Config()
    data = data["ripple"] if isinstance(data.get("ripple"), dict) else data
    fan_out = data.get("fan_out_threshold", FAN_OUT)
    llm = data.get("llm") if isinstance(data.get("llm"), dict) else {}
    return Config(fan_out if isinstance(fan_out, int) and not isinstance(fan_out, bool) and fan_out >= 1 else FAN_OUT, truth(llm.get("captions", False)))


def truth(value) -> bool:
    return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")


@dataclass(frozen=True)
class LabelSettings:
    enabled: bool = False
    provider: str = "openai"
    api_key: str = ""
    model: str = ""
    base_url: str = ""
    concurrency: int = 8


def label_settings(env: dict[str, str] | None = None) -> LabelSettings:
    """From RIPPLE_LLM_* variables; concurrency is kept within 1 to 16. Read on the driver, never broadcast."""
    env = os.environ if env is None else env
    get = lambda k, d="": env.get(f"RIPPLE_LLM_{k}", d)
    n = get("CONCURRENCY", "8")
    return LabelSettings(truth(get("ENABLED", "0")), get("PROVIDER", "openai").lower(), get("API_KEY"), get("MODEL"), get("BASE_URL"), min(16, max(1, int(n) if n.isdigit() else 8)))


def use_labels(force: bool | None, overlays: bool, config: Config, settings: LabelSettings) -> bool:
    """Never over overlays; a forced no is no; without a key (but for a local provider) no; else a forced yes, else the configuration."""
    if overlays or force is False or not settings.api_key and settings.provider != "ollama":
        return False
    return bool(force) or config.captions
