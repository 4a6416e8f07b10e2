"""Project configuration: one dataclass, checked field by field."""

from __future__ import annotations

import datetime
import json
import re
from dataclasses import dataclass, field

from ..operators.rules import Boundary, Budget, override_error

# Paths of generated code by preset.
GENERATED = {"openapi": ("**/generated/**", "**/*.gen.ts", "**/openapi/**"), "graphql": ("**/__generated__/**", "**/*.generated.ts"), "prisma": ("**/prisma/client/**",)}


@dataclass
class Config:
    entries: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    layers: dict[str, str] = field(default_factory=dict)
    boundaries: list[Boundary] = field(default_factory=list)
    budgets: list[Budget] = field(default_factory=list)
    generated: tuple[str, ...] = ()
    generated_mode: str = "classify"  # exclude, classify or include
    hot_zones: int = 10
    git_window: str = "90d"
    loaders: tuple[dict, ...] = ()
    suppressions: tuple[dict, ...] = ()
    today: str = field(default_factory=lambda: datetime.date.today().isoformat())  # decides what has expired


def load(text: str) -> tuple[Config, list[str]]:
    """The configuration and what is wrong with it; wrong fields keep their defaults."""
    problems: list[str] = []
    try:
        data = json.loads(text)
    except ValueError as e:
        return Config(), [f"not JSON: {e}"]
    if not isinstance(data, dict):
        return Config(), ["the configuration must be an object"]
    out = Config()

    def strings(name: str) -> tuple[str, ...]:
        value = data.get(name, [])
        if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
            problems.append(f"{name}: a list of strings is expected")
            return ()
        return tuple(value)

    out.entries, out.exclude = strings("entries"), strings("exclude")
    for pattern, name in (data.get("layers") or {}).items():
        if why := override_error(pattern, name):
            problems.append(f"layers.{pattern}: {why}")
        else:
            out.layers[pattern] = name
    for k, r in enumerate(data.get("boundaries") or []):
        if not {"name", "from", "to"} <= r.keys() or r.get("mode", "must-not") not in ("must-not", "can-only"):
            problems.append(f"boundaries[{k}]: name, from, to and a mode of must-not or can-only are expected")
            continue
        out.boundaries.append(Boundary(r["name"], r["from"], r["to"], r.get("mode", "must-not"), tuple(r.get("except", ())), bool(r.get("crossInstance")), r.get("severity", "error")))
    for k, r in enumerate(data.get("budgets") or []):
        limits = {c: r[n] for n, c in (("maxFanIn", "fan_in"), ("maxFanOut", "fan_out"), ("maxLoc", "loc")) if n in r}
        if not {"name", "module"} <= r.keys() or not all(isinstance(v, int) and v >= 0 for v in limits.values()):
            problems.append(f"budgets[{k}]: name, module and limits of 0 or more are expected")
            continue
        out.budgets.append(Budget(r["name"], r["module"], limits, r.get("maxCycles"), r.get("severity", "error")))
    presets = strings("generatedPresets")
    problems += [f"generatedPresets: no such preset: {p}" for p in presets if p not in GENERATED]
    out.generated = strings("generated") + tuple(g for p in presets for g in GENERATED.get(p, ()))
    out.generated_mode = data.get("generatedMode", "classify")
    if out.generated_mode not in ("exclude", "classify", "include"):
        problems.append("generatedMode: exclude, classify or include is expected")
        out.generated_mode = "classify"
    loaders, hidden = [], []
    for k, x in enumerate(data.get("loaders") or []):
        if isinstance(x, dict) and isinstance(x.get("name"), str) and isinstance(x.get("resolveAs"), str) and isinstance(x.get("argIndex", 0), int):
            loaders.append(x)
        else:
            problems.append(f"loaders[{k}]: name, resolveAs and a whole argIndex are expected")
    for k, x in enumerate(data.get("suppressions") or []):
        if isinstance(x, dict) and isinstance(x.get("stableKey"), str) and all(isinstance(x.get(c), str | None) for c in ("module", "expires")):
            hidden.append(x)
        else:
            problems.append(f"suppressions[{k}]: stableKey and, as texts, module and expires are expected")
    out.loaders, out.suppressions = tuple(loaders), tuple(hidden)
    window = (data.get("git") or {}).get("window", out.git_window)
    if isinstance(window, str) and re.fullmatch(r"\d+[dwmy]", window):
        out.git_window = window
    else:
        problems.append("git.window: a number of d, w, m or y is expected")
    if isinstance(n := data.get("hotZones", 10), int) and n > 0:
        out.hot_zones = n
    else:
        problems.append("hotZones: a number above 0 is expected")
    problems += [f"{k}: unknown field" for k in data if k not in ("entries", "exclude", "layers", "boundaries", "budgets", "generated", "generatedPresets", "generatedMode", "hotZones", "git", "loaders", "suppressions")]
    return out, problems


def initial(layers: list[str], entries: list[str]) -> str:
    """A first configuration for a project."""
    return json.dumps({"entries": sorted(entries), "layers": {f"src/{x}/**": x for x in layers}, "boundaries": [], "budgets": []}, indent=2)


def type_only(line: str) -> str:
    """An import line that names types only, as a type import; other lines unchanged."""
    return re.sub(r"^(\s*)import\s+(?!type\b)(\{[^}]*\}|\w+)(\s+from\s)", r"\1import type \2\3", line)
