"""Classes of files by path and size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Files above this size are not indexed.
MAX_BYTES = 700_000
# Extensions that hold text, names that say what a file is, names and endings that hold secrets, and parts
# of a name that speak of them.
TEXT_EXT = "md mdx txt rst py ipynb js jsx ts tsx mjs cjs json jsonl toml yaml yml ini cfg csv tsv sql sh ps1 bat cmd html css scss vue svelte java go rs cpp c h hpp cs r m tex"
PRIORITY_NAMES = (
    "readme agents architecture design_notes repository_architecture repository_structure repository_map project_summary data_card model_card package.json pyproject.toml requirements.txt environment.yml conda.yml setup.py setup.cfg "
    "dockerfile docker-compose.yml docker-compose.yaml makefile justfile vite.config.ts vite.config.js next.config.js next.config.mjs tsconfig.json"
)
LOW_VALUE = r"(?:^|/)(?:package-lock\.json|pnpm-lock\.yaml|[^/]*\.lock)$|(?:^|/)(?:__pycache__|node_modules|\.git|dist|build)/"
SENSITIVE = r"(?:^|/)(?:\.env(?:\.[a-z]+)?|\.npmrc|\.pypirc|id_(?:rsa|dsa|ecdsa|ed25519)|auth\.json|token\.json)$|\.(?:pem|key|p12|pfx|crt)$|secret|credential|private_key|api_?key|(?:access|refresh)_token"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def classify(path: Column, size: Column) -> Column:
    """sensitive, low_value, large, priority, source or unsupported; the first that applies."""
    p = F.lower(F.translate(path, "\\", "/"))
    name = F.element_at(F.split(p, "/"), -1)
    stem = F.regexp_replace(name, r"\.[a-z0-9]+$", "")
    text = extension(path).isin(*TEXT_EXT.split())
    priority = name.isin(*PRIORITY_NAMES.split()) | (stem.isin(*PRIORITY_NAMES.split()) & text)
    return F.when(p.rlike(SENSITIVE), "sensitive").when(p.rlike(LOW_VALUE), "low_value").when(size > MAX_BYTES, "large").when(priority, "priority").when(text, "source").otherwise("unsupported")


def skip_reason(kind: Column) -> Column:
    """Why a class of files is not indexed; null for those that are."""
    return F.when(kind == "sensitive", "sensitive_path").when(kind == "low_value", "policy_excluded").when(kind == "large", "file_too_large").when(kind == "unsupported", "unsupported_type")


# Names and folders of files that tell most about a project.
_HIGH_NAMES = "agents.md pyproject.toml package.json requirements.txt environment.yml setup.py dockerfile docker-compose.yml makefile tsconfig.json"
_HIGH_FOLDERS = "docs doc tests test submission"
_HIGH_WORDS = "report result metric benchmark eval"


def high_value(path: Column) -> Column:
    """Whether a file ought to be indexed first of all: readmes, project files, documents, tests, results."""
    p = F.lower(F.translate(path, "\\", "/"))
    name = F.element_at(F.split(p, "/"), -1)
    return name.startswith("readme") | name.isin(*_HIGH_NAMES.split()) | p.rlike("^(?:" + "|".join(_HIGH_FOLDERS.split()) + ")/") | p.rlike("|".join(_HIGH_WORDS.split()))


def triage(path: Column) -> Column:
    """Sensitive paths in four classes: key, environment, credential, token; null for others."""
    p = F.lower(F.translate(path, "\\", "/"))
    return (
        F.when(p.rlike(r"(?:^|/)id_(?:rsa|dsa|ecdsa|ed25519)$|\.(?:pem|key|p12|pfx|crt)$|private_key"), "key")
        .when(p.rlike(r"(?:^|/)\.(?:env(?:\.[a-z]+)?|npmrc|pypirc)$"), "environment")
        .when(p.rlike(r"secret|credential|(?:^|/)auth\.json$"), "credential")
        .when(p.rlike(r"(?:access|refresh)_token|api_?key|(?:^|/)token\.json$"), "token")
    )


#: Text that must not be indexed: private-key headers, provider keys and literal assignments to secret names.
SECRET_TEXT = r"(?i)-----BEGIN [A-Z ]*PRIVATE KEY-----|\b(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36})\b|\b(?:password|passwd|api_?key|client_secret|access_token|auth_token)\b[\"']?\s*[:=]+\s*[\"'][^\"'$<{*\s]{8,}[\"']"
