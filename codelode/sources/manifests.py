"""Lock files as dependency edges.

``read`` takes files (path, content) of any of the formats and yields
(project, parent, child, parent_version, child_version, ordinal); the project
is the file's path, and the root's name where a format has none is ``.``.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from codelode.sources.perfile import rows_per_file

SCHEMA = "project string, parent string, child string, parent_version string, child_version string, ordinal long"
Edge = tuple[str, str, str | None, str | None]


def cargo_lock(text: str) -> Iterator[Edge]:
    packages = tomllib.loads(text).get("package", [])
    versions = {p["name"]: p["version"] for p in packages}
    for p in packages:
        for d in p.get("dependencies", []):
            name, *rest = d.split()
            yield p["name"], name, p["version"], rest[0] if rest else versions.get(name)


def toml_packages(text: str) -> Iterator[Edge]:
    """uv.lock and poetry.lock."""
    packages = tomllib.loads(text).get("package", [])
    versions = {p["name"]: p.get("version") for p in packages}
    for p in packages:
        own = p.get("dependencies", [])
        for name in own if isinstance(own, dict) else [d["name"] for d in own]:
            yield p["name"], name, p.get("version"), versions.get(name)


def npm_lock(text: str) -> Iterator[Edge]:
    data = json.loads(text)
    packages = data.get("packages", {})
    for path, p in packages.items():
        name = p.get("name") or (path.rpartition("node_modules/")[2] if path else data.get("name", "."))
        for kind in ("dependencies", "devDependencies") if not path else ("dependencies",):
            for child in p.get(kind, {}):
                # the nearest folder above that holds it
                at, found = path, None
                while True:
                    found = packages.get(f"{at}/node_modules/{child}" if at else f"node_modules/{child}")
                    if found or not at:
                        break
                    at = at.rpartition("/node_modules/")[0] if "/node_modules/" in at else ""
                yield name, child, p.get("version"), found and found.get("version")


def yarn_lock(text: str) -> Iterator[Edge]:
    blocks: list[tuple[list[str], str | None, list[str]]] = []
    heads, version, children, inside = [], None, [], False
    for line in [*text.splitlines(), "end:"]:
        if not line.strip() or line.startswith("#"):
            continue
        if not line.startswith(" "):
            if heads:
                blocks.append((heads, version, children))
            heads, version, children, inside = [h.strip().strip('"') for h in line.rstrip(":").split(",")], None, [], False
        elif re.match(r"  \S", line):
            inside = line.strip() in ("dependencies:", "optionalDependencies:")
            if m := re.match(r'  "?version"?:? "?([^"\s]+)"?', line):
                version = m[1]
        elif inside and (m := re.match(r'    "?(@?[^"\s@:]+(?:/[^"\s:]+)?)"?:? ', line + " ")):
            children.append(m[1])
    name = lambda h: h[: h.rindex("@")] if "@" in h[1:] else h
    versions = {name(h): v for heads, v, _ in blocks for h in heads}
    for heads, v, children in blocks:
        for c in children:
            yield name(heads[0]), c, v, versions.get(c)


def pnpm_lock(text: str) -> Iterator[Edge]:
    """The ``snapshots`` (or ``packages``) section, read by indent."""
    section, key, inside = "", "", False
    for line in text.splitlines():
        if m := re.match(r"(\w+):\s*$", line):
            section, key, inside = m[1], "", False
        elif section in ("snapshots", "packages"):
            if m := re.match(r"  '?/?([^'\s][^']*?)'?:", line):
                key, inside = m[1], False
            elif re.match(r"    \S", line):
                inside = line.strip() in ("dependencies:", "optionalDependencies:")
            elif inside and key and (m := re.match(r"      '?([^'\s:]+(?:/[^'\s:]+)?)'?: '?([^'\s(]+)", line)):
                name, _, version = key.split("(")[0].rpartition("@")
                yield name, m[1], version, m[2]


def bun_lock(text: str) -> Iterator[Edge]:
    data = json.loads(re.sub(r",(\s*[}\]])", r"\1", text))
    packages = data.get("packages", {})
    version = lambda n: packages[n][0].rpartition("@")[2] if n in packages else None
    for path, space in data.get("workspaces", {}).items():
        for child in {**space.get("dependencies", {}), **space.get("devDependencies", {})}:
            yield space.get("name", path or "."), child, space.get("version"), version(child)
    for name, spec in packages.items():
        info = next((x for x in spec[1:] if isinstance(x, dict)), {})
        for child in info.get("dependencies", {}):
            yield name, child, version(name), version(child)


def gem_lock(text: str) -> Iterator[Edge]:
    versions = dict(re.findall(r"^    ([^\s(]+) \(([^)]+)\)$", text, re.M))
    parent = "."
    for line in text.splitlines():
        if m := re.match(r"    ([^\s(]+) \(", line):
            parent = m[1]
        elif (m := re.match(r"      ([^\s(]+)", line)) and parent != ".":
            yield parent, m[1], versions.get(parent), versions.get(m[1])
        elif re.match(r"  ([^\s(!]+)", line) and not line.startswith("    "):
            child = line.split()[0].rstrip("!")
            if child in versions:
                yield ".", child, None, versions[child]


def composer_lock(text: str) -> Iterator[Edge]:
    data = json.loads(text)
    packages = data.get("packages", []) + data.get("packages-dev", [])
    versions = {p["name"]: p.get("version") for p in packages}
    for p in packages:
        for child in p.get("require", {}):
            if child in versions:
                yield p["name"], child, p.get("version"), versions[child]


def go_sum(text: str) -> Iterator[Edge]:
    seen = {}
    for line in text.splitlines():
        parts = line.split()
        if len(parts) == 3 and not parts[1].endswith("/go.mod"):
            seen[parts[0]] = parts[1]
    for name, version in seen.items():
        yield ".", name, None, version


def mix_lock(text: str) -> Iterator[Edge]:
    found = {m[0]: (m[1], m[2]) for m in re.findall(r'"([^"]+)": \{:hex, :\w+, "([^"]+)"(.*)', text)}
    for name, (version, rest) in found.items():
        for child in re.findall(r"\{:(\w+), \"", rest):
            yield name, child, version, found.get(child, (None,))[0]


def gradle_lock(text: str) -> Iterator[Edge]:
    for group, name, version in re.findall(r"^([^#:\s]+):([^:\s]+):([^=\s]+)=", text, re.M):
        yield ".", f"{group}:{name}", None, version


def nuget_lock(text: str) -> Iterator[Edge]:
    for packages in json.loads(text).get("dependencies", {}).values():
        for name, p in packages.items():
            if p.get("type") == "Direct":
                yield ".", name, None, p.get("resolved")
            for child, version in p.get("dependencies", {}).items():
                yield name, child, p.get("resolved"), packages.get(child, {}).get("resolved", version)


def flake_lock(text: str) -> Iterator[Edge]:
    nodes = json.loads(text).get("nodes", {})
    rev = lambda n: nodes.get(n, {}).get("locked", {}).get("rev")
    for name, node in nodes.items():
        for child in node.get("inputs", {}).values():
            child = child if isinstance(child, str) else child[-1]
            yield name, child, rev(name), rev(child)


def conan_lock(text: str) -> Iterator[Edge]:
    data = json.loads(text)
    for spec in data.get("requires", []) + data.get("build_requires", []):
        name, _, version = spec.split("#")[0].partition("/")
        yield ".", name, None, version


def deno_lock(text: str) -> Iterator[Edge]:
    data = json.loads(text)
    for section in ("jsr", "npm"):
        own = data.get(section) or data.get("packages", {}).get(section, {})
        for key, p in own.items():
            name, _, version = key.rpartition("@")
            for child in p.get("dependencies", []):
                child = child.split(":", 1)[-1]
                at = child.rfind("@")
                yield name, child[:at] if at > 0 else child, version, child[at + 1 :] if at > 0 else None


def pipfile_lock(text: str) -> Iterator[Edge]:
    data = json.loads(text)
    for section in ("default", "develop"):
        for name, p in data.get(section, {}).items():
            yield ".", name, None, p.get("version", "").lstrip("=") or None


FORMATS: dict[str, Callable[[str], Iterator[Edge]]] = {
    "Cargo.lock": cargo_lock, "uv.lock": toml_packages, "poetry.lock": toml_packages, "pdm.lock": toml_packages, "Pipfile.lock": pipfile_lock, "package-lock.json": npm_lock, "yarn.lock": yarn_lock,
    "pnpm-lock.yaml": pnpm_lock, "bun.lock": bun_lock, "Gemfile.lock": gem_lock, "composer.lock": composer_lock, "go.sum": go_sum, "mix.lock": mix_lock, "gradle.lockfile": gradle_lock,
    "buildscript-gradle.lockfile": gradle_lock, "packages.lock.json": nuget_lock, "flake.lock": flake_lock, "conan.lock": conan_lock, "deno.lock": deno_lock,
}


def read(files: DataFrame) -> DataFrame:
    """Edges of all lock files among files (path, content); a file that doesn't parse gives none."""

    names = ("parent", "child", "parent_version", "child_version")

    def rows(path, content):
        form = FORMATS.get(path.rpartition("/")[2])
        for k, edge in enumerate(form(content) if form else ()):
            yield {"project": path, **dict(zip(names, edge)), "ordinal": k}

    return rows_per_file(files, rows, SCHEMA, (ValueError, KeyError, TypeError, AttributeError))


def requirement(text: str) -> tuple[str, str | None, bool]:
    """(name, version requirement, optional) of a Python requirement."""
    spec, _, marker = text.partition(";")
    m = re.match(r"\s*([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*\(?([^)]*)\)?", spec)
    return m[1], m[2].strip() or None, "extra" in marker
