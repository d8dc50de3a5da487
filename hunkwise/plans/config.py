"""Settings of a review from a TOML file: weights of rules, more sensitive paths, reviewer profiles.

    [weights]
    size = 0.5

    [[surface]]
    pattern = "(^|/)payments/"
    points = 12
    reason = "touches the payments module"

    [profiles.payments]
    auth = 1.4
"""

from __future__ import annotations

import tomllib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession

from hunkwise.functions.rx import rx
from hunkwise.operators.profiles import ProfileError, checked

FILE_NAME = ".hunkwise.toml"
#: Rules that may be weighted.
WEIGHTED = ("size", "surface", "danger", "blast-radius", "hotspots", "owners", "no-tests", "intent")


class ConfigError(ValueError):
    """Settings that cannot be read, with the place."""


def checked_weights(weights: object) -> dict[str, float]:
    if not isinstance(weights, Mapping):
        raise ConfigError("[weights] must be a table of rule = number")
    for name, w in weights.items():
        if name not in WEIGHTED:
            raise ConfigError(f"unknown rule {name!r} in [weights]; there are {', '.join(WEIGHTED)}")
        if isinstance(w, bool) or not isinstance(w, int | float) or not w >= 0:
            raise ConfigError(f"the weight of {name!r} must be a number from 0 on, not {w!r}")
    return {name: float(w) for name, w in weights.items()}


def pattern_fault(pattern: str) -> str | None:
    """Why the JVM, which matches patterns, cannot read one; None if it can. Without a session, which comes after
    the settings on the command line, one is started."""
    try:
        spark().sparkContext._jvm.java.util.regex.Pattern.compile(rx(pattern, ignore_case=True))
    except IllegalArgumentException as e:
        return str(e).splitlines()[0]
    return None


def spark() -> SparkSession:
    """The session, or a small local one."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName("hunkwise").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    session = builder.config("spark.sql.shuffle.partitions", "4").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def checked_surfaces(surfaces: Sequence[tuple[object, object, object]]) -> tuple[tuple[str, int, str], ...]:
    """(pattern, points, reason) of more sensitive paths; patterns are matched whatever the case."""
    for i, (pattern, points, reason) in enumerate(surfaces, 1):
        if not isinstance(pattern, str) or not pattern:
            raise ConfigError(f"surface {i}: the pattern must be text")
        if isinstance(points, bool) or not isinstance(points, int) or points <= 0:
            raise ConfigError(f"surface {i}: the points must be a whole number from 1 on, not {points!r}")
        if not isinstance(reason, str) or not reason:
            raise ConfigError(f"surface {i}: the reason must be text")
        if words := pattern_fault(pattern):
            raise ConfigError(f"surface {i}: not a pattern: {pattern!r}: {words}")
    return tuple((str(p), int(n), str(r)) for p, n, r in surfaces)


@dataclass(frozen=True)
class Config:
    weights: dict[str, float] = field(default_factory=dict)
    extra_surface: tuple[tuple[str, int, str], ...] = ()
    profiles: dict[str, dict[str, float]] = field(default_factory=dict)
    path: Path | None = None

    @property
    def is_default(self) -> bool:
        return not (self.weights or self.extra_surface or self.profiles)


def find_config(start: Path, file_name: str = FILE_NAME) -> Path | None:
    """The nearest file of that name in a folder or above it."""
    start = start.resolve()
    folders = (start, *start.parents) if start.is_dir() else start.parents
    return next((f / file_name for f in folders if (f / file_name).is_file()), None)


def parse_config(data: Mapping[str, object], path: Path | None = None) -> Config:
    surfaces = data.get("surface") or []
    profiles = data.get("profiles") or {}
    try:
        if not isinstance(surfaces, list) or not all(isinstance(s, Mapping) for s in surfaces):
            raise ConfigError("[[surface]] must be an array of tables with pattern, points and reason")
        if not isinstance(profiles, Mapping):
            raise ConfigError("[profiles] must be a table of named profiles")
        return Config(
            checked_weights(data.get("weights", {})),
            checked_surfaces([(s.get("pattern"), s.get("points"), s.get("reason")) for s in surfaces]),
            checked(profiles), path,
        )
    except (ConfigError, ProfileError) as e:
        raise ConfigError(f"{path}: {e}" if path else str(e)) from e


def load_config(explicit: Path | None = None, start: Path | None = None, enabled: bool = True, file_name: str = FILE_NAME) -> Config:
    """The file that is named, or the nearest one from ``start`` (the current folder) up; else no settings."""
    if not enabled:
        return Config()
    if explicit is not None and not explicit.is_file():
        raise ConfigError(f"there is no settings file {explicit}")
    path = explicit or find_config(start or Path.cwd(), file_name)
    if path is None:
        return Config()
    try:
        return parse_config(tomllib.loads(path.read_text(encoding="utf-8")), path)
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise ConfigError(f"{path}: not TOML: {e}") from e
