"""Control of libraries: their registry, selections and summaries, and writes that need a confirmation.

All of it is small and lives on the driver, as one table with a row for each library.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import re
import secrets as random_source
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from .functions.paths import scope

PROPOSAL_SECONDS = 600
WRONG_CODES = 5  # of a proposal, before it is closed
SUMMARY_LENGTH = 300
LIBRARY = "name string, path string, selection_in array<string>, selection_out array<string>, selection_default string, options string, summary string, summary_source string, summary_at double, summary_fingerprint string"


def clean_path(path: str) -> str:
    """A selection path; ValueError if it isn't relative and sound. The same rule as paths.normalised."""
    if not isinstance(path, str):
        raise ValueError(f"not a path: {path!r}")
    s = path.strip().replace("\\", "/")
    parts = [p.strip() for p in s.strip("/").split("/")]
    if re.match(r"^(/|~|[A-Za-z]:)", s) or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"not a relative path inside the library: {path!r}")
    return "/".join(parts)


@dataclass
class Library:
    name: str
    path: str
    selection_in: list[str] = field(default_factory=list)
    selection_out: list[str] = field(default_factory=list)
    selection_default: str = "follow"
    options: dict[str, Any] = field(default_factory=dict)
    summary: str = ""
    summary_source: str = "none"
    summary_at: float = 0.0
    summary_fingerprint: str = ""

    def choose(self, changes: Iterable[tuple[str, str]]) -> None:
        """(path, in | out | neutral) in order; the last one for a path holds."""
        wanted = {clean_path(p): a for p, a in changes}
        if bad := set(wanted.values()) - {"in", "out", "neutral"}:
            raise ValueError(f"unknown actions: {', '.join(sorted(bad))}")
        pick = lambda old, action: sorted({p for p in old if p not in wanted} | {p for p, a in wanted.items() if a == action})
        self.selection_in, self.selection_out = pick(self.selection_in, "in"), pick(self.selection_out, "out")

    def resolve_conflict(self, directory: str) -> None:
        """Takes a directory out of this library's exclusions and includes it explicitly."""
        kept = [d for d in self.options.get("exclude_dirs", []) if d.replace("\\", "/").strip().strip("/") != directory]
        self.options["exclude_dirs"] = kept
        self.choose([(directory, "in")])

    def stale_summary(self, fingerprint: str) -> bool:
        return bool(self.summary) and self.summary_fingerprint != fingerprint


class Registry:
    def __init__(self, libraries: Iterable[Library] = ()):
        self._by_name = {x.name: x for x in libraries}

    def __iter__(self):
        return iter(self._by_name.values())

    def get(self, name: str) -> Library:
        if name not in self._by_name:
            raise ValueError(f"unknown library: {name}")
        return self._by_name[name]

    def add(self, name: str, path: str, **options) -> Library:
        if not name or name.strip() != name or len(name) > 64 or re.search(r'[/\\:*?"<>|]', name):
            raise ValueError(f"not a library name: {name!r}")
        if name in self._by_name:
            raise ValueError(f"library exists: {name}")
        self._by_name[name] = Library(name, path, options=options)
        return self._by_name[name]

    def remove(self, name: str) -> None:
        self.get(name)
        del self._by_name[name]

    def scope(self, requested: Iterable[str] = (), excluded: Iterable[str] = (), defaults: Iterable[str] = ()) -> list[str]:
        return scope(list(requested), list(excluded), list(defaults), list(self._by_name))

    def rows(self) -> list[tuple]:
        return [(x.name, x.path, x.selection_in, x.selection_out, x.selection_default, json.dumps(x.options), x.summary, x.summary_source, x.summary_at, x.summary_fingerprint) for x in self]

    @classmethod
    def of(cls, rows: Iterable) -> Registry:
        return cls(Library(**(r.asDict() | {"options": json.loads(r["options"] or "{}")})) for r in rows)


class Gate:
    """Writes in two steps: a proposal, then its confirmation by a six-digit code that is shown to the
    user alone. One proposal at a time; a code works once, and for PROPOSAL_SECONDS; after WRONG_CODES
    wrong ones the proposal is closed."""

    def __init__(self, show: Callable[[str], None], clock: Callable[[], float] = time.time):
        self._show, self._clock, self._open, self._wrong = show, clock, None, 0

    def propose(self, library: str, what: Any) -> str:
        code = f"{random_source.randbelow(10**6):06d}"
        number = random_source.token_hex(8)
        self._open, self._wrong = (number, library, hashlib.sha256(code.encode()).hexdigest(), self._clock(), what), 0
        self._show(code)
        return number

    def confirm(self, library: str, number: str, code: str) -> Any:
        if self._open is None or self._open[:2] != (number, library):
            raise ValueError("no such proposal")
        _, _, digest, made, what = self._open
        if self._clock() - made > PROPOSAL_SECONDS:
            self._open = None
            raise ValueError("the proposal has expired")
        if not hmac.compare_digest(digest, hashlib.sha256(code.strip().encode()).hexdigest()):
            self._wrong += 1
            if self._wrong >= WRONG_CODES:
                self._open = None
            raise ValueError("wrong code")
        self._open = None
        return what


def summary_prompt(name: str, samples: list[str], titles: list[str]) -> str:
    """What a model is asked for a library's summary."""
    parts = [f"Describe the document library '{name}' in at most {SUMMARY_LENGTH} characters.", "Files: " + "; ".join(titles[:50]), *[f"[{i + 1}] {s[:400]}" for i, s in enumerate(samples)]]
    return "\n".join(parts)


def read_summary(answer: str) -> str:
    """A model's answer as a summary: without fence, quotes and line ends, at most SUMMARY_LENGTH long, cut
    at the end of a sentence where there is one."""
    text = re.sub(r"^\s*```\w*\n|\n```\s*$", "", answer.strip())
    text = " ".join(text.split()).strip("\"'“”")
    if len(text) <= SUMMARY_LENGTH:
        return text
    head = text[:SUMMARY_LENGTH]
    stop = max(head.rfind(c) for c in ".!?。！？")
    return head[: stop + 1] if stop > SUMMARY_LENGTH // 2 else head


def edit_settings(text: str, changes: dict[str, Any]) -> str:
    """All of several changes, or none: KeyError if any key isn't there."""
    for key, value in changes.items():
        text = edit_setting(text, key, value)
    return text


def backfill_settings(text: str, missing: dict[str, Any]) -> str:
    """The settings that a text of JSON with comments lacks, put before its last brace."""
    if not missing:
        return text
    end = text.rstrip().rfind("}")
    if end < 0:
        return json.dumps(missing, ensure_ascii=False, indent=2)
    head = text[:end].rstrip()
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", head, flags=re.DOTALL).rstrip()
    lines = ",\n".join(f"  {json.dumps(k)}: {json.dumps(v, ensure_ascii=False)}" for k, v in missing.items())
    return head + ("" if bare.endswith(("{", ",")) else "\n  ,") + "\n" + lines + "\n" + text[end:]


def edit_setting(text: str, key: str, value: Any) -> str:
    """Replaces one setting's value in JSON with comments and leaves everything else as it is."""
    token = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.DOTALL)
    for m in token.finditer(text):
        if m[0] == json.dumps(key) and (c := re.compile(r"\s*:\s*").match(text, m.end())):
            start, depth, i = c.end(), 0, c.end()
            while i < len(text):
                t = token.match(text, i)
                if t and (t[0][0] == '"' or depth):
                    i = t.end()
                    continue
                if t or (depth == 0 and text[i] in ",}\n"):
                    break
                depth += (text[i] in "[{") - (text[i] in "]}")
                i += 1
            end = start + len(text[start:i].rstrip())
            return text[:start] + json.dumps(value, ensure_ascii=False) + text[end:]
    raise KeyError(key)
