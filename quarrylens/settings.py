"""Settings from the environment and a .env file; paths that are not set follow from the root."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "QUARRYLENS_"
#: where things are below the root, unless they are set
BELOW_ROOT = {"home": "out", "tables": "out/graph.db", "ast_dir": "out/ast", "catalog": "out/rules.yaml", "contract": "out/openapi.yaml", "generated": "out/generated", "cases": "cases", "report": "out/report.md", "divergences": "out/divergences.md"}


@dataclass(frozen=True)
class Settings:
    root: Path
    home: Path
    tables: Path
    ast_dir: Path
    catalog: Path
    contract: Path
    generated: Path
    cases: Path
    report: Path
    divergences: Path
    parser: str = ""
    parser_timeout: int = 120
    generator: str = "openapi-generator-cli"
    generator_timeout: int = 900
    new_system_url: str = ""


def read_env_file(path: Path) -> dict[str, str]:
    """NAME=value lines; blank lines and comments count for nothing, quotes around a value are taken off."""
    out = {}
    for line in path.read_text().splitlines() if path.is_file() else ():
        name, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and not name.startswith("#"):
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def load(env: dict[str, str] | None = None, folder: str | Path = ".") -> Settings:
    """The environment goes before the file, names in any case, unknown ones are ignored."""
    given = read_env_file(Path(folder) / ".env") | dict(os.environ if env is None else env)
    low = {k.upper().removeprefix(PREFIX).lower(): v for k, v in given.items() if k.upper().startswith(PREFIX) and v}
    root = Path(low.get("root", folder))
    values: dict = {}
    for f in fields(Settings):
        if f.name in low:
            values[f.name] = Path(low[f.name]) if f.name in BELOW_ROOT or f.name == "root" else int(low[f.name]) if f.name.endswith("timeout") else low[f.name]
        elif f.name in BELOW_ROOT:
            values[f.name] = root / BELOW_ROOT[f.name]
    return Settings(**{"root": root} | values)
