"""Settings of an audit, read from TOML, with presets."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from .lexicon import IGNORED


class ConfigError(ValueError):
    """A setting that can't be used."""


@dataclass(frozen=True)
class AuditConfig:
    target: str = "en"
    leak_threshold: float = 0.08
    min_words: int = 3
    check_capitals: bool = True
    check_quotes: bool = False
    dedup: bool = True
    merge: bool = True
    min_detect_chars: int = 20
    min_confidence: float = 0.5
    min_block_chars: int = 10
    max_verify_chars: int = 1000  # blocks of so many aren't verified (0: all are)
    max_detect_chars: int = 10_000  # their language is that of so many (0: of the whole block)
    max_nesting: int = 10  # strings that lie deeper in a block are left out (0: none is)
    sure: float = 0.7
    ignore_rules: tuple[str, ...] = ()
    enable_rules: tuple[str, ...] = ()
    whitelist: tuple[str, ...] = ()
    ignore_selectors: tuple[str, ...] = IGNORED
    max_sample_tokens: int = 200
    severity: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.target not in ("es", "en", "nl"):
            raise ConfigError(f"no such target language: {self.target}")
        for share in ("leak_threshold", "min_confidence", "sure"):
            if not 0 <= getattr(self, share) <= 1:
                raise ConfigError(f"{share} is a share")
        for selector in self.ignore_selectors:
            parse_selector(selector)


#: Attribute selectors: [name], [name="value"], and with *=, ^= or $= for parts of the value.
ATTRIBUTE = re.compile(r"""\[\s*([\w:.-]+)\s*(?:([*^$~]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]"']+)))?\s*\]""")


def parse_selector(selector: str) -> tuple[str, ...]:
    """("class", name), ("id", name), ("attr", name, operator, value) or ("tag", name)."""
    if selector[:1] in (".", "#") and len(selector) > 1:
        return ("class" if selector[0] == "." else "id", selector[1:])
    if selector[:1] == "[":
        if not (m := ATTRIBUTE.fullmatch(selector)):
            raise ConfigError(f"no such selector: {selector}")
        return ("attr", m[1].lower(), m[2] or "", next((x for x in m.groups()[2:] if x is not None), ""))
    if not re.fullmatch(r"[\w-]+", selector):
        raise ConfigError(f"no such selector: {selector}")
    return ("tag", selector.lower())


MINIMAL = {"leak_threshold": 0.15, "min_words": 5, "check_capitals": False}
STRICT = {"leak_threshold": 0.05, "min_words": 2, "dedup": False, "merge": False, "check_quotes": True}


def preset(name: str, base: AuditConfig | None = None) -> AuditConfig:
    """minimal, strict or default."""
    changes = {"minimal": MINIMAL, "strict": STRICT, "default": {}}
    if name not in changes:
        raise ConfigError(f"no such preset: {name}")
    return replace(base or AuditConfig(), **changes[name])


#: Sections about clients, windows and logs, which an audit doesn't use.
ELSEWHERE = ("languagetool", "spellcheck", "fetcher", "export", "ui", "logging")


def whitelist_file(path: Path) -> tuple[str, ...]:
    """Terms, in lower case, of lines `term` or `term:lang`; a term counts whatever its language."""
    lines = (x.strip() for x in path.read_text("utf-8").splitlines())
    return tuple(dict.fromkeys(x.split(":", 1)[0].strip().lower() for x in lines if x and not x.startswith("#")))


def load(path: str | None = None) -> AuditConfig:
    """Reads target.language and rules.* of a TOML file: the given one, else veriglot.toml here or in ~/.config. A
    whitelist is a list of terms or the path of a file of them, from the TOML file's folder on. Keys of these two
    sections that an audit doesn't know are errors, as are other sections than those in ELSEWHERE."""
    places = [Path(path)] if path else [Path("veriglot.toml"), Path.home() / ".config" / "veriglot.toml"]
    found = next((p for p in places if p.exists()), None)
    if found is None:
        if path:
            raise ConfigError(f"no such file: {path}")
        return AuditConfig()
    raw = tomllib.loads(found.read_text())
    values, target = dict(raw.get("rules", {})), dict(raw.get("target", {}))
    if target.pop("render_js", False):
        raise ConfigError("pages are not rendered: render_js has to be false")
    if "language" in target:
        values["target"] = target.pop("language")
    known = {f.name for f in fields(AuditConfig)}
    if unknown := [*(f"target.{k}" for k in target), *(f"rules.{k}" for k in values if k not in known), *(k for k in raw if k not in ("target", "rules", *ELSEWHERE))]:
        raise ConfigError(f"no such settings: {', '.join(sorted(unknown))}")
    if isinstance(values.get("whitelist"), str):
        listed = found.parent / values["whitelist"]
        values["whitelist"] = whitelist_file(listed) if listed.exists() else ()
    return AuditConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
