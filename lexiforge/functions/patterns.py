"""The wildcard language: patterns are compiled on the driver into one regular expression.

``*`` any run, ``.`` one character, ``[abc]``, ``[a-z]``, ``[^...]``, and placeholders ``A``, ``AA``, ``T``,
``TT``, ``TTT`` (bare or bracketed) for vowels, consonants and usual clusters. Alternatives become one
alternation, so a pattern with several of them is still one scan, never a union of scans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# What the placeholders stand for, as published.
VOWELS = "aeiou"
CONSONANTS = "bcdfghjklmnpqrstvwxyz"
VOWEL_PAIRS = ["ai", "ay", "ee", "ea", "oa", "oo", "ie", "ei", "ey", "au", "aw", "ow", "ou", "oi", "oy", "ue", "ui", "eu", "ew", "oe"]
CLUSTERS_2 = [
    "sp", "st", "tr", "cr", "gr", "fr", "pr", "br", "dr", "pl", "bl", "cl", "fl", "gl", "sl", "sc", "sk", "sm", "sn", "sw",
    "tw", "dw", "qu", "kn", "wr", "wh", "th", "ch", "sh", "ph", "gn", "rh",
]
CLUSTERS_3 = ["str", "spr", "scr", "spl", "thr", "shr", "squ", "sph", "sch"]
PLACEHOLDERS: dict[str, str | list[str]] = {"A": VOWELS, "T": CONSONANTS, "AA": VOWEL_PAIRS, "TT": CLUSTERS_2, "TTT": CLUSTERS_3}

_BARE = re.compile(r"\[[^\]]*\]|\^(?:T{1,3}|A{1,3}|.)|T{1,3}|A{1,3}", re.S)
_PIECES = re.compile(r"\[[^\]]*\]|\*|\.|\[.*|[^*.\[]+", re.S)
_META = re.compile(r"([\\.^$|?*+()\[\]{}])")


def add_brackets(pattern: str) -> str:
    """Bare placeholders and bare ``^x`` put into brackets; what is bracketed, and an unclosed bracket, stays."""
    return _BARE.sub(lambda m: m.group() if m.group()[0] == "[" else f"[{m.group()}]", pattern)


def has_wildcard(pattern: str) -> bool:
    return "*" in pattern or "." in pattern or ("[" in pattern and "]" in pattern)


def escape(text: str) -> str:
    return _META.sub(r"\\\1", text)


def _char_class(body: str) -> str:
    negated = body.startswith("^")
    inner = body[1:] if negated else body
    if not inner:
        return "" if negated else r"[^\x{0}-\x{10FFFF}]"
    return f"[{'^' if negated else ''}{re.sub(r'([\\\[\]&^])', r'\\\1', inner)}]"


def _bracket(body: str, expand_negated: bool) -> str:
    found = PLACEHOLDERS.get(body)
    if isinstance(found, list):
        return f"(?:{'|'.join(found)})"
    if isinstance(found, str):
        return f"[{found}]"
    if expand_negated and body.startswith("^") and isinstance(PLACEHOLDERS.get(body[1:]), str):
        return f"[^{PLACEHOLDERS[body[1:]]}]"
    return _char_class(body.lower())


@dataclass(frozen=True)
class Compiled:
    """``body`` matches a whole lower-case word; ``literal`` is the word itself if there is nothing to expand."""

    body: str
    literal: str | None
    prefix: str

    @property
    def java(self) -> str:
        return rf"(?s)\A(?:{self.body})\z"


def compile_pattern(pattern: str, literal: bool = False, expand_negated: bool = False) -> Compiled:
    """``literal`` takes the pattern as a word; ``expand_negated`` reads ``[^A]`` as "no vowel" (by default it is "not the letter a")."""
    text = pattern.strip()
    if literal:
        return Compiled(escape(text.lower()), text.lower(), text.lower())
    text = add_brackets(text)
    out, prefix, open_prefix = [], "", True
    for piece in _PIECES.findall(text):
        if piece == "*":
            out.append(".*")
        elif piece == ".":
            out.append(".")
        elif piece[0] == "[" and piece[-1] == "]" and len(piece) > 1:
            out.append(_bracket(piece[1:-1], expand_negated))
        elif piece[0] == "[":  # never closed: matches nothing
            out.append(r"[^\x{0}-\x{10FFFF}]")
        else:
            out.append(escape(piece.lower()))
            prefix += piece.lower() if open_prefix else ""
            continue
        open_prefix = False
    return Compiled("".join(out), text.lower() if open_prefix else None, prefix)


def like_pattern(pattern: str, legacy: bool = False) -> str:
    """``*`` and ``.`` as SQL LIKE; ``%`` and ``_`` of the user are literal unless ``legacy``."""
    text = pattern if legacy else re.sub(r"([\\%_])", r"\\\1", pattern)
    return text.replace("*", "%").replace(".", "_")


def star_regex(pattern: str) -> str:
    """Only ``*`` is a wildcard; anchored, for use without case."""
    return "^" + ".*".join(escape(p) for p in pattern.split("*")) + "$"


def literal_runs(pattern: str) -> list[str]:
    """The literal stretches between wildcards and brackets, in order."""
    return [p for p in re.split(r"\[[^\]]*\]|[*.]", add_brackets(pattern)) if p]
