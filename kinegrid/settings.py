"""Settings of a registration run, typed, from TOML: unknown names and values of another kind raise."""

from __future__ import annotations

import dataclasses
import tomllib
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Recording:
    frames: int
    width: int
    height: int
    slices: int
    channels: int = 1
    rate: float = 1.0  # frames a second
    spacing: float = 1.0
    z_spacing: float = 1.0
    bytes_per_element: int = 4

    @property
    def z_ratio(self) -> float:
        return self.z_spacing / self.spacing

    def frame(self, minutes: float) -> int:
        """The frame at a time, inside the recording."""
        return min(max(round(minutes * 60 * self.rate), 0), self.frames - 1)

    def minutes(self, frame: int) -> float:
        return frame / self.rate / 60

    def frame_bytes(self) -> int:
        return self.width * self.height * self.slices * self.channels * self.bytes_per_element


@dataclass(frozen=True)
class Solver:
    layers: int = 3
    radius: int = 5
    rounds: int = 12
    smooth: float = 0.05
    step: float = 1.0
    tolerance: float = 1e-3

    def options(self) -> dict:
        return dataclasses.asdict(self)


@dataclass(frozen=True)
class Scan:
    window: int = 5
    chunk: int = 10
    block: int = 10
    decay: float = 0.7
    first_minute: float = 0.0
    last_minute: float | None = None


@dataclass(frozen=True)
class Settings:
    recording: Recording
    solver: Solver = field(default_factory=Solver)
    scan: Scan = field(default_factory=Scan)

    def frames(self) -> tuple[int, int]:
        """First frame and the one after the last."""
        last = self.recording.frames - 1 if self.scan.last_minute is None else self.recording.frame(self.scan.last_minute)
        first = self.recording.frame(self.scan.first_minute)
        if first > last:
            raise ValueError("the run ends before it begins")
        return first, last + 1

    def task_bytes(self) -> int:
        """What a scan's task holds, about: the rolling window, the frame, its reference, and the solver's fields and
        tensors (three displacements, six products, six working copies in doubles)."""
        element = self.recording.frame_bytes() // self.recording.channels // self.recording.bytes_per_element
        return self.recording.frame_bytes() * (self.scan.window + 2) + element * 8 * 15


def parse(text: str) -> Settings:
    given = tomllib.loads(text)
    parts = {}
    for f in dataclasses.fields(Settings):
        kind = {"recording": Recording, "solver": Solver, "scan": Scan}[f.name]
        values = given.pop(f.name, {})
        if not isinstance(values, dict):
            raise ValueError(f"{f.name}: not a table")
        parts[f.name] = kind(**_checked(kind, f.name, values))
    if given:
        raise ValueError(f"unknown: {', '.join(sorted(given))}")
    return Settings(**parts)


def _checked(kind: type, table: str, values: dict) -> dict:
    known = {f.name: f for f in dataclasses.fields(kind)}
    out = {}
    for name, value in values.items():
        if name not in known:
            raise ValueError(f"{table}.{name}: unknown")
        wants = float if "float" in str(known[name].type) else int
        if isinstance(value, bool) or not isinstance(value, int | float) or wants is int and not isinstance(value, int):
            raise ValueError(f"{table}.{name}: not a {wants.__name__}")
        if not value >= 0 or value in (float("inf"),):
            raise ValueError(f"{table}.{name}: out of range")
        out[name] = wants(value)
    for name, f in known.items():
        if name not in out and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
            raise ValueError(f"{table}.{name}: missing")
    return out
