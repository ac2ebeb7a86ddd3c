"""The experiment configuration: what to load and how to cut it into blocks."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path
from typing import NamedTuple


class ExperimentConfig(NamedTuple):
    symbols: tuple[str, ...]
    interval: str
    months: tuple[str, ...]
    block_size: int


def _is_text(value: object) -> bool:
    return isinstance(value, str) and value != ""


def _are_texts(value: object) -> bool:
    return isinstance(value, list) and len(value) > 0 and all(map(_is_text, value))


#: Field of the configuration: where it stands in the document, what it must be, and how a failure is told.
_RULES: dict[str, tuple[str, Callable[[object], bool], str]] = {
    "symbols": ("data.symbols", _are_texts, "a non-empty list of strings"),
    "interval": ("data.interval", _is_text, "a non-empty string"),
    "months": ("data.months", lambda v: _are_texts(v) and all(re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", m) for m in v), "a non-empty list of months like 2024-01"),
    "block_size": ("covariance.block_size", lambda v: type(v) is int and v >= 2, "an integer of at least 2"),
}


def parse_experiment_config(document: object) -> ExperimentConfig:
    """A configuration from a parsed document; every field is looked up by its path and held against its rule."""
    found = {}
    for field, (path, rule, wanted) in _RULES.items():
        value = document
        for step in path.split("."):
            if not isinstance(value, dict):
                raise ValueError(f"{path} needs a mapping around {step}")
            value = value.get(step)
        if not rule(value):
            raise ValueError(f"{path} must be {wanted}")
        found[field] = tuple(value) if isinstance(value, list) else value
    return ExperimentConfig(**found)


def load_experiment_config(path: str | Path) -> ExperimentConfig:
    import yaml

    return parse_experiment_config(yaml.safe_load(Path(path).read_text()))
