"""Projects below a folder: their ids, overrides and git state. Listings are of one folder level and stay on the driver."""

from __future__ import annotations

import re
from pathlib import Path

from strataseek.functions.text import slug_text

#: Folders that are no projects.
IGNORED_NAMES = frozenset(".git node_modules __pycache__ .venv venv dist build .cache worktrees site-packages tmp temp".split())


def check_overrides(root: str, overrides: dict[str, str]) -> dict[Path, str]:
    """Absolute folder -> project id; folders may lie outside the root. Ids must be slugs and unique."""
    out = {}
    for folder, project_id in overrides.items():
        path = Path(folder)
        path = path if path.is_absolute() else Path(root) / path
        if slug_text(project_id) != project_id:
            raise ValueError(f"{project_id} is no project id")
        out[path.resolve()] = project_id
    if len(set(out.values())) < len(out):
        raise ValueError("two folders have one project id")
    return out


def project_id_for(path: Path, overrides: dict[Path, str]) -> str:
    """The id a folder was given, else the slug of its name."""
    return overrides.get(path.resolve(), slug_text(path.name))


def discover(root: str, overrides: dict[str, str] | None = None, ignored: frozenset[str] = IGNORED_NAMES) -> list[dict]:
    """project_id, name, path, is_git, git_head of each child folder of a root and each folder of the overrides, by id.

    Hidden and ignored folders are no projects unless an override names them;
    an override that does not exist is an error. Of two folders with one id
    the one of the override counts, else the first by path.
    """
    known = check_overrides(root, overrides or {})
    for path in known:
        if not path.is_dir():
            raise ValueError(f"{path} is no folder")
    children = [p for p in sorted(Path(root).iterdir()) if p.is_dir() and not p.name.startswith(".") and p.name.lower() not in ignored]
    out: dict[str, dict] = {}
    for path in [*sorted(known), *children]:
        key = project_id_for(path, known)
        if key not in out:
            head = git_head(path)
            out[key] = {"project_id": key, "name": path.name, "path": str(path), "is_git": (path / ".git").exists(), "git_head": head}
    return [out[k] for k in sorted(out)]


def git_head(path: Path | str) -> str | None:
    """The commit a working folder stands at, read from its files; null where there is none."""
    git = Path(path) / ".git"
    try:
        if git.is_file():  # a worktree or submodule points to its folder
            m = re.match(r"gitdir: (.+)", git.read_text())
            git = (Path(path) / m.group(1).strip()) if m else git
        head = (git / "HEAD").read_text().strip()
        if not head.startswith("ref: "):
            return head if re.fullmatch(r"[0-9a-f]{40,64}", head) else None
        ref = head[5:]
        common = git / (git / "commondir").read_text().strip() if (git / "commondir").exists() else git
        for base in (git, common):
            if (base / ref).is_file():
                return (base / ref).read_text().strip()
        packed = (common / "packed-refs").read_text() if (common / "packed-refs").exists() else ""
        m = re.search(rf"(?m)^([0-9a-f]{{40,64}}) {re.escape(ref)}$", packed)
        return m.group(1) if m else None
    except OSError:
        return None
