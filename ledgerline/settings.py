"""Scan settings from a JSON file."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields

from .functions.patterns import DEFAULT_IGNORED

MAX_BYTES = 1 << 20


@dataclass(frozen=True)
class Settings:
    include_absolute_paths: bool = False
    follow_symbolic_links: bool = False
    allow_outside_root: bool = False
    calculate_sha256: bool = True
    use_rescan_cache: bool = False
    refresh_rescan_cache: bool = False
    sbom_author_organization: str = ""
    sbom_author_email: str = ""
    remember_privacy_choices: bool = False
    ignore_patterns: tuple[str, ...] = DEFAULT_IGNORED


def load(path: str) -> Settings:
    """A plain object of settings, or one under scan_settings with format_version 1.
    Members that are missing or null keep their defaults; one of a wrong type is an error."""
    if os.path.getsize(path) > MAX_BYTES:
        raise ValueError("the settings file is too large")
    with open(path, encoding="utf-8") as f:
        root = json.load(f)
    if not isinstance(root, dict):
        raise ValueError("the settings are no JSON object")
    given = root
    if "scan_settings" in root:
        given, version = root["scan_settings"], root.get("format_version", 1)
        if not isinstance(given, dict) or isinstance(version, bool) or version != 1:
            raise ValueError("the settings' format is not supported")
    found = {}
    for f in fields(Settings):
        value = given.get(f.name)
        if value is None:
            continue
        if f.name == "ignore_patterns":
            if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
                raise ValueError("ignore_patterns is no list of texts")
            value = tuple(value)
        elif type(value) is not type(f.default):
            raise ValueError(f"{f.name} has a wrong type")
        found[f.name] = value
    return Settings(**found)
