"""Which steps and dates are done: JSON records on the driver, written whole and renamed."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable
from pathlib import Path


def write_json(path: str | Path, data) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f"{path.name}.{os.getpid()}.part")
    part.write_text(json.dumps(data, indent=1, sort_keys=True, default=str))
    part.replace(path)


def settings_hash(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def file_digest(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def verify_bundle(folder: str | Path, listed: dict[str, str]) -> list[str]:
    """Files of a model bundle that are missing or changed."""
    folder = Path(folder)
    return [name for name, digest in listed.items() if not (folder / name).is_file() or file_digest(folder / name) != digest]


def folder_digests(folder: str | Path, suffixes: tuple[str, ...] = ()) -> dict[str, str]:
    """Digests of all files under a folder by their path in it; with suffixes only of those, such as the code of a package."""
    folder = Path(folder)
    return {str(p.relative_to(folder)): file_digest(p) for p in sorted(folder.rglob("*")) if p.is_file() and (not suffixes or p.suffix in suffixes) and "__pycache__" not in p.parts}


def folder_digest(folder: str | Path, suffixes: tuple[str, ...] = ()) -> str:
    return settings_hash(folder_digests(folder, suffixes))


def write_manifest(folder: str | Path, **more) -> dict:
    """manifest.json of a folder: digests of its files and what else is said of it. Written last, it says that the folder is whole."""
    folder = Path(folder)
    listed = {n: d for n, d in folder_digests(folder).items() if n != "manifest.json"}
    data = {"files": listed, **more}
    write_json(folder / "manifest.json", data)
    return data


def versions(root: str | Path, component: str) -> list[str]:
    """Versions (folders v<digits> with a manifest) of a component, oldest first."""
    return sorted(p.name for p in (Path(root) / component).glob("v[0-9]*") if (p / "manifest.json").is_file())


def pinned_version(root: str | Path, component: str, pin: str = "latest") -> str | None:
    """The pinned version, or the latest; None if there is none. Raises if a pinned one is not there."""
    found = versions(root, component)
    if pin == "latest":
        return found[-1] if found else None
    if pin not in found:
        raise FileNotFoundError(f"{component} has no version {pin}; there are {found}")
    return pin


def load_bundle(root: str | Path, pins: dict[str, str]) -> dict:
    """{component: {version, manifest, folder}} and bundle_id, after all listed files were hashed again; raises if any differs or a component is not there."""
    out: dict = {}
    for component, pin in pins.items():
        version = pinned_version(root, component, pin)
        if version is None:
            raise FileNotFoundError(f"there is no {component}")
        folder = Path(root) / component / version
        manifest = json.loads((folder / "manifest.json").read_text())
        if not manifest.get("files") or (bad := verify_bundle(folder, manifest["files"])):
            raise ValueError(f"{component} {version}: {bad if manifest.get('files') else 'the manifest lists no files'}")
        out[component] = {"version": version, "manifest": file_digest(folder / "manifest.json"), "folder": str(folder)}
    return out | {"bundle_id": settings_hash({c: v["manifest"] for c, v in out.items()})}


class Ledger:
    """Events of named steps in a JSON-lines file; the latest event of a step says how it stands."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def events(self) -> list[dict]:
        return [json.loads(x) for x in self.path.read_text().splitlines()] if self.path.exists() else []

    def log(self, step: str, event: str, **more) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("a") as f:
            f.write(json.dumps({"step": step, "event": event, "time": time.time(), **more}) + "\n")

    def latest(self, step: str) -> dict | None:
        return next((e for e in reversed(self.events()) if e["step"] == step), None)

    def run(self, step: str, f: Callable[[], object], marker: str | Path | None = None, force: bool = False, fingerprint: str | None = None):
        """Runs a step once: skipped if it is logged as done, its marker (if any) exists and its data are the same."""
        last = self.latest(step)
        done = last and last["event"] == "done" and (marker is None or Path(marker).exists()) and last.get("fingerprint") == fingerprint
        if done and not force:
            self.log(step, "done", skipped=True, fingerprint=fingerprint)
            return None
        self.log(step, "started", fingerprint=fingerprint)
        try:
            out = f()
        except Exception as e:
            self.log(step, "failed", error=str(e)[:500])
            raise
        self.log(step, "done", fingerprint=fingerprint)
        return out


def pending(dates: list[str], markers: dict[str, dict], settings: str) -> list[str]:
    """Dates without a marker of the same settings."""
    return [d for d in dates if markers.get(d, {}).get("settings") != settings]


def changed_inputs(now: list[tuple[str, int, float]], state: dict[str, list]) -> list[str]:
    """Inputs to read again: the first changed one and all after it, since earlier files win when copies are dropped."""
    for i, (name, size, mtime) in enumerate(now):
        if state.get(name) != [size, mtime]:
            return [n for n, _, _ in now[i:]]
    return []


def lock_split(path: str | Path, split: dict[str, list[str]], force: bool = False) -> dict[str, list[str]]:
    """Writes a split once; later it must be over the same ids. Forcing keeps the old one beside it."""
    path = Path(path)
    ids = sorted(i for own in split.values() for i in own)
    if len(set(ids)) != len(ids):
        raise ValueError("an id is in two splits")
    mark = hashlib.sha256("\n".join(ids).encode()).hexdigest()
    if path.exists():
        old = json.loads(path.read_text())
        if old["fingerprint"] == mark and not force:
            return old["split"]
        if not force:
            raise ValueError("the split was made for other ids")
        path.replace(path.with_suffix(".old.json"))
    write_json(path, {"fingerprint": mark, "split": split})
    return split
