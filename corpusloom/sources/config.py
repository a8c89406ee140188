"""Options: JSON with comments, typed by their defaults."""

from __future__ import annotations

import json
import re
from typing import Any

#: Strings are matched first, so that comment signs inside them stay.
_COMMENT = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.DOTALL)
_TRAILING = re.compile(r'"(?:\\.|[^"\\])*"|,(?=\s*[}\]])', re.DOTALL)

#: The names of the options, their defaults, and which must be above 0.
DEFAULTS: dict[str, Any] = {
    "extensions": ["md", "txt", "pdf", "docx"],
    "exclude_dirs": [".obsidian", ".smart-env", ".trash", ".git", "TEMP", "templates"],
    "exclude_files": [],
    "exclude_patterns": [],
    "tbd_exclude_ratio": 0.1,
    "chunk_char_limit": 600,
    "short_doc_char_limit": 200,
    "max_chunks_per_file": 3,
    "small_to_big": True,
    "bm25_k1": 1.5,
    "bm25_b": 0.75,
    "fusion_dense_weight": 1.0,
    "fusion_bm25_weight": 1.0,
    "dense_candidate_factor": 8,
    "dense_min_candidates": 200,
    "rerank_candidates": 50,
    "default_top_k": 5,
    "confidence_warn_threshold": 0.30,
    "confidence_drop_threshold": 0.0,
}
POSITIVE = ("chunk_char_limit", "short_doc_char_limit", "max_chunks_per_file", "bm25_k1", "dense_candidate_factor", "dense_min_candidates", "default_top_k")


def parse(text: str) -> dict[str, Any]:
    keep = lambda m: m[0] if m[0].startswith('"') else ""
    return json.loads(_TRAILING.sub(keep, _COMMENT.sub(keep, text)) or "{}")


def coerce(value: Any, default: Any, positive: bool = False) -> Any:
    """value, if it has the type of default, else the default: no text is a number or a switch, no switch is
    a number, no fraction a whole number; a whole number is a fraction too."""
    kind = type(default)
    if kind is list:
        return value if isinstance(value, list) and all(isinstance(x, str) for x in value) else default
    if kind is float and type(value) is int:
        value = float(value)
    if type(value) is not kind or (positive and value <= 0):
        return default
    return value


def load(text: str, defaults: dict[str, Any] | None = None) -> tuple[dict[str, Any], list[str]]:
    """(options, names of keys that the text lacks). Unknown keys are dropped."""
    base = DEFAULTS if defaults is None else defaults
    try:
        found = parse(text)
    except ValueError:
        found = {}
    found = found if isinstance(found, dict) else {}
    return {k: coerce(found[k], d, k in POSITIVE) if k in found else d for k, d in base.items()}, [k for k in base if k not in found]


def effective(options: dict[str, Any], library: dict[str, Any]) -> dict[str, Any]:
    """Options of a library: its own where it has them, in the types of the defaults; agent formats only among its
    extensions."""
    own = {k: coerce(v, DEFAULTS[k], k in POSITIVE) if k in DEFAULTS else v for k, v in library.items() if v is not None}
    out = options | own
    if "agent_formats" in out:
        out["agent_formats"] = [e for e in out["extensions"] if e in set(out["agent_formats"] or [])]
    return out
