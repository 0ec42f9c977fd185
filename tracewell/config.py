"""Configuration: defaults, a YAML file over them, command-line values over both."""

from __future__ import annotations

import copy
import os
from dataclasses import dataclass, field
from typing import Any

import yaml

from tracewell.operators.advise import check_endpoint
from tracewell.sources.corpus import IGNORED

DEFAULTS: dict[str, dict[str, Any]] = {
    "scan": {"parser": "auto", "ignore_dirs": list(IGNORED), "include_globs": [], "exclude_globs": []},
    "llm": {"enabled": True, "provider": "ollama", "host": "http://localhost:11434", "model": "qwen3-coder:30b", "temperature": 0.1,
            "timeout_seconds": 120, "max_retries": 1, "cache_enabled": True, "priority": "high", "limit": 0},
    "privacy": {"allow_external_llm": False},
    "database": {"path": ".tracewell/store"},
    "cache": {"dir": ".tracewell/cache"},
    "output": {"dir": "tracewell-report"},
}


def merged(base: dict, over: dict | None) -> dict:
    out = copy.deepcopy(base)
    for k, v in (over or {}).items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


@dataclass
class Config:
    data: dict[str, Any] = field(default_factory=lambda: copy.deepcopy(DEFAULTS))

    def __getattr__(self, name: str) -> dict[str, Any]:
        if name in DEFAULTS:
            return self.data[name]
        raise AttributeError(name)

    @classmethod
    def load(cls, path: str | None = None) -> "Config":
        """The first of path, or config/application.yaml, or application.yaml that exists, over the defaults."""
        for p in [path] if path else ["config/application.yaml", "application.yaml"]:
            if os.path.isfile(p):
                with open(p, encoding="utf-8") as f:
                    return cls(merged(DEFAULTS, yaml.safe_load(f)))
        return cls()

    def override(self, *, model=None, host=None, no_llm=False, output=None, database=None, llm_priority=None, llm_limit=None,
                 include=None, exclude=None, parser=None) -> None:
        """Set what is given."""
        for section, key, value in (("llm", "model", model), ("llm", "host", host), ("output", "dir", output), ("database", "path", database),
                                    ("llm", "priority", llm_priority), ("scan", "include_globs", include and list(include)), ("scan", "parser", parser)):
            if value:
                self.data[section][key] = value
        if llm_limit is not None:
            self.data["llm"]["limit"] = llm_limit
        if no_llm:
            self.data["llm"]["enabled"] = False
        # A pattern excludes paths, a plain name a folder.
        for x in exclude or ():
            self.data["scan"]["exclude_globs" if "*" in x or "/" in x else "ignore_dirs"].append(x)

    def check_endpoint(self) -> None:
        check_endpoint(self.llm["host"], self.privacy["allow_external_llm"])
