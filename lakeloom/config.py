"""Settings that change results, and their sources: INI file, environment, overrides (in rising order of precedence)."""

from __future__ import annotations

import configparser
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

#: Survivor criteria, and those that take no tolerance: fixed values.
CRITERIA = ("oldest", "newest", "largest", "smallest", "longest", "shortest", "best_meta", "longest_clean_name")
NO_TOLERANCE = ("oldest", "newest", "best_meta")


class ConfigError(ValueError):
    """All problems of a configuration, one a line."""


@dataclass(frozen=True)
class FuzzyConfig:
    """Scoring of candidate pairs."""

    enable: bool = False
    matching_mode: str = "set"
    threshold: float = 0.90
    max_duration_diff_sec: int = 3
    name_power: float = 1.5
    duration_power: float = 4.0
    size_power: float = 0.9
    weight_name: float = 0.50
    weight_duration: float = 0.30
    weight_size: float = 0.20
    penalty_numbers_mismatch: float = 0.08
    use_jaccard_penalty: bool = False
    use_meta_fuzzy: bool = True

    def problems(self) -> list[str]:
        """What is wrong with the values."""
        found = []
        if abs(self.weight_name + self.weight_duration + self.weight_size - 1) > 0.01:
            found.append("the weights must sum to 1")
        if self.max_duration_diff_sec < 0:
            found.append("max_duration_diff_sec must not be negative")
        if self.name_power <= 0:
            found.append("name_power must be positive")
        if self.duration_power < 0 or self.size_power < 0:
            found.append("duration_power and size_power must not be negative")
        return found


@dataclass(frozen=True)
class Settings:
    """Everything that queries take from a configuration."""

    fuzzy: FuzzyConfig = field(default_factory=FuzzyConfig)
    keep_priority: tuple[tuple[str, float], ...] = (("oldest", 0.0),)
    dry_run: bool = True
    batch_delete_size: int = 100
    sync_batch_size: int = 7000
    verify_chunk_size: int = 200
    max_backups: int = 5
    chat_label_parts: tuple[str, ...] = ("title", "username", "id")
    ignore_ids: tuple[tuple[str, int], ...] = ()
    ignore_patterns: tuple[tuple[str, str], ...] = ()


def parse_keep_priority(items: list[str], keep_newest: bool = False) -> tuple[tuple[tuple[str, float], ...], list[str]]:
    """(criterion, tolerance) levels of ``name`` or ``name ~ N%`` items, and the problems found.

    Without items the only level is age. A cascade that lacks an age level ends with ``oldest``.
    """
    if not items:
        return (("newest" if keep_newest else "oldest", 0.0),), []
    levels: dict[str, float] = {}
    problems: list[str] = []
    for item in items:
        name, tilde, tolerance = (x.strip() for x in item.partition("~"))
        name, share = name.lower(), 0.0
        try:
            share = float(tolerance.removesuffix("%")) / 100 if tolerance else 0.0
            known = True
        except ValueError:
            known = False
        problem = (
            f"unknown criterion {name!r}" if name not in CRITERIA
            else f"{name!r} is listed twice" if name in levels
            else f"no tolerance after '~' of {name!r}" if tilde and not tolerance
            else f"{name!r} takes no tolerance" if tolerance and name in NO_TOLERANCE
            else f"tolerance {tolerance!r} of {name!r} is no percentage" if not known
            else f"tolerance of {name!r} must be between 0 and 100 %" if not 0 <= share <= 1
            else ""
        )
        if problem:
            problems.append(problem)
        else:
            levels[name] = share
    if {"oldest", "newest"} <= set(levels):
        problems.append("oldest and newest exclude each other")
    if not {"oldest", "newest"} & set(levels):
        levels["oldest"] = 0.0
    return tuple(levels.items()), problems


def _listed(text: str) -> list[str]:
    return [x.strip() for line in text.splitlines() for x in line.split(",") if x.strip()]


def load_config(path: str | None = None, env: Mapping[str, str] | None = None, overrides: Mapping[str, str] | None = None) -> Settings:
    """Settings from an INI file, ``LAKELOOM_SECTION__OPTION`` variables and ``section.option`` overrides.

    Every problem is collected; if there is any, one ConfigError lists them all.
    """
    parser = configparser.ConfigParser(interpolation=None, strict=False)
    problems: list[str] = []
    if path is not None and not parser.read(path, encoding="utf-8"):
        problems.append(f"{path} cannot be read")
    placed = [(k[len("LAKELOOM_") :].lower().split("__", 1), v) for k, v in (os.environ if env is None else env).items() if k.startswith("LAKELOOM_") and "__" in k]
    placed += [(k.split(".", 1), v) for k, v in (overrides or {}).items()]
    for place, value in placed:
        if len(place) != 2:
            problems.append(f"{place[0]!r} is not section.option")
            continue
        if not parser.has_section(place[0]):
            parser.add_section(place[0])
        parser.set(place[0], place[1], value)

    def read(section: str, name: str, default: object) -> object:
        if not parser.has_option(section, name):
            return default
        try:
            if isinstance(default, bool):
                return parser.getboolean(section, name)
            return type(default)(parser.get(section, name).strip())
        except ValueError:
            problems.append(f"{section}.{name}: {parser.get(section, name)!r} is not of type {type(default).__name__}")
            return default

    known = {f.name for f in fields(FuzzyConfig)}
    for name in parser.options("fuzzy_matching") if parser.has_section("fuzzy_matching") else []:
        if name not in known:
            problems.append(f"unknown option fuzzy_matching.{name}")
    values = {f.name: read("fuzzy_matching", f.name, f.default) for f in fields(FuzzyConfig)}
    values["matching_mode"] = "set" if str(values["matching_mode"]).lower() == "set" else "sort"
    fuzzy = FuzzyConfig(**values)
    problems += fuzzy.problems()
    keep, wrong = parse_keep_priority(_listed(parser.get("core", "keep_priority", fallback="")), bool(read("core", "keep_newest_duplicate", False)))
    ids, patterns = [], []
    for scope, text in parser.items("ignore_list") if parser.has_section("ignore_list") else []:
        for item in _listed(text):
            if item.isdecimal():
                ids.append((scope, int(item)))
            else:
                problems.append(f"ignore_list.{scope}: {item!r} is no id")
    for scope, text in parser.items("ignore_regex") if parser.has_section("ignore_regex") else []:
        patterns += [(scope, line.strip()) for line in text.splitlines() if line.strip()]
    labels = tuple(_listed(parser.get("logging", "chat_label_parts", fallback="title, username, id")))
    settings = Settings(
        fuzzy, keep, bool(read("core", "dry_run", True)), max(1, min(100, int(read("performance", "batch_delete_size", 100)))), int(read("performance", "sync_batch_size", 7000)),
        int(read("performance", "verify_chunk_size", 200)), int(read("backup", "max_backups", 5)), labels, tuple(ids), tuple(patterns),
    )
    if problems or wrong:
        raise ConfigError("\n".join(problems + wrong))
    return settings
