"""An optional driver tool: fetch the configured archives and their sidecars from a given base address."""

from __future__ import annotations

from pathlib import Path
from urllib.request import urlretrieve

from panelforge.config import ExperimentConfig


def archive_addresses(base: str, config: ExperimentConfig) -> list[str]:
    """The address of every archive and, after it, of its sidecar: {base}/{symbol}/{interval}/{file}."""
    found = []
    for symbol in config.symbols:
        for month in config.months:
            address = f"{base.rstrip('/')}/{symbol}/{config.interval}/{symbol}-{config.interval}-{month}.zip"
            found += [address, f"{address}.CHECKSUM"]
    return found


def download(base: str, config: ExperimentConfig, directory: str) -> list[Path]:
    Path(directory).mkdir(parents=True, exist_ok=True)
    paths = []
    for address in archive_addresses(base, config):
        path = Path(directory) / address.rsplit("/", 1)[1]
        if not path.exists():
            urlretrieve(address, path)
        paths.append(path)
    return paths
