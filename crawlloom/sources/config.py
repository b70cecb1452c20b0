"""Configuration of a crawl: a JSON object, explicit settings over it, and their checks."""

from __future__ import annotations

import difflib
import json
import re
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any

from ..functions.urls import TRACKING_PARAMS
from ..operators.crawl import Limits
from ..operators.scope import LinkRules, Scope


class ConfigError(ValueError):
    """Settings that are missing, unknown or out of range."""


def _number(least: float, strict: bool = False, whole: bool = False, optional: bool = False):
    def check(name: str, value: Any) -> None:
        if optional and value is None:
            return
        kinds = int if whole else (int, float)
        if isinstance(value, bool) or not isinstance(value, kinds) or value < least or (strict and value == least):
            raise ConfigError(f"{name} must be {'a whole number' if whole else 'a number'} {'above' if strict else 'of at least'} {least}, got {value!r}")

    return check


def _flag(name: str, value: Any) -> None:
    if not isinstance(value, bool):
        raise ConfigError(f"{name} must be true or false, got {value!r}")


_CHECKS = {
    "delay": _number(0), "page_load_timeout": _number(0), "settle_timeout": _number(0), "max_pages": _number(0, True, optional=True), "max_depth": _number(0, True, optional=True),
    "max_runtime": _number(0, True, optional=True), "max_attempts": _number(1, whole=True), "max_consecutive_failures": _number(1, whole=True, optional=True), "max_restarts": _number(0, whole=True),
    **dict.fromkeys(("respect_robots", "headless", "include_subdomains", "restrict_to_path", "keep_query", "hash_routing", "respect_canonical"), _flag),
}


@dataclass(frozen=True)
class Config:
    """Settings by name. Those of a browser are read and checked, but recorded pages have no use for them."""

    base_url: str | None = None
    delay: float = 1.0
    respect_robots: bool = True
    user_agent: str = "crawlloom/1.0"
    headless: bool = True
    window_size: tuple[int, int] = (1440, 980)
    page_load_timeout: float = 30.0
    settle_timeout: float = 8.0
    wait_for_selector: str | None = None
    include_subdomains: bool = False
    restrict_to_path: bool = True
    keep_query: bool = True
    hash_routing: bool = False
    respect_canonical: bool = True
    strip_query_params: tuple[str, ...] = TRACKING_PARAMS
    exclude_patterns: tuple[str, ...] = ()
    max_pages: int | None = None
    max_depth: int | None = None
    max_runtime: float | None = None
    max_attempts: int = 3
    max_consecutive_failures: int | None = 10
    max_restarts: int = 3
    sites_dir: str = "sites"

    def __post_init__(self):
        for name, check in _CHECKS.items():
            check(name, getattr(self, name))
        try:
            if self.base_url is None:
                for pattern in self.exclude_patterns:
                    re.compile(pattern)
            else:
                self.policy()
        except (ValueError, AttributeError, TypeError, re.error) as e:
            raise ConfigError(str(e)) from e

    @classmethod
    def of(cls, settings: dict[str, Any]) -> Config:
        known = {f.name for f in fields(cls)}
        for name in settings:
            if name not in known:
                near = difflib.get_close_matches(name, sorted(known), 1, 0.7)
                raise ConfigError(f"unknown setting {name!r}" + (f"; is {near[0]!r} meant?" if near else ""))
        lists = {"strip_query_params", "exclude_patterns", "window_size"}
        for name in lists & settings.keys():
            if isinstance(settings[name], str) or not isinstance(settings[name], (list, tuple)):
                raise ConfigError(f"{name} must be a list, got {settings[name]!r}")
        return cls(**{k: tuple(v) if k in lists else v for k, v in settings.items()})

    @classmethod
    def load(cls, path: str | Path | None = None, **settings: Any) -> Config:
        """The file's settings, with those given put over them; None leaves the file's. A named file must exist."""
        found: Any = {}
        file = Path(path or "config.json")
        if path is not None and not file.is_file():
            raise ConfigError(f"there is no file {file}")
        if file.is_file():
            try:
                found = json.loads(file.read_text(encoding="utf-8"))
            except (OSError, ValueError) as e:
                raise ConfigError(f"can't read {file}: {e}") from e
            if not isinstance(found, dict):
                raise ConfigError(f"{file} must hold an object")
        return cls.of(found | {k: v for k, v in settings.items() if v is not None})

    @property
    def scope(self) -> Scope:
        if self.base_url is None:
            raise ConfigError("a base URL is needed")
        return Scope.from_url(self.base_url, include_subdomains=self.include_subdomains, restrict_to_path=self.restrict_to_path)

    def policy(self) -> LinkRules:
        return LinkRules(self.scope, keep_query=self.keep_query, hash_routing=self.hash_routing, strip_params=tuple(self.strip_query_params), exclude=tuple(self.exclude_patterns))

    def limits(self) -> Limits:
        return Limits(self.max_pages, self.max_depth, self.max_runtime, self.max_attempts, self.max_consecutive_failures, self.max_restarts)
