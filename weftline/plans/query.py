"""Queries on the driver: terms, subjects, relaxed and alias forms, verticals."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass

from .. import fixed as X
from ..functions.text import UNSEEN

_GAP = re.compile(f"[{X.SEPARATORS}]+")
_COMMON = frozenset([*X.QUALIFIERS, *X.GENERIC])
_DULL = sorted({w for w in [*X.GENERIC, *X.PEELABLE_TOO] if len(w) > 1}, key=lambda w: (-len(w), w))
#: A common word at the start of a token of which two characters more are left; the same for what is read backwards.
_AHEAD = re.compile(f"({'|'.join(map(re.escape, _DULL))})(?=..)", re.DOTALL)
_BEHIND = re.compile(f"({'|'.join(re.escape(w[::-1]) for w in _DULL)})(?=..)", re.DOTALL)


@dataclass(frozen=True)
class Query:
    """terms: all, folded; subjects: those that say what is meant; required: subjects without categories and seasons."""

    terms: tuple[str, ...]
    subjects: tuple[str, ...]
    required: tuple[str, ...]


def distinct(items: Iterable[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(items))


def _eat(pattern: re.Pattern, token: str) -> tuple[list[str], str]:
    """The words that a pattern takes from the start of a token one by one, and what is left."""
    words = []
    while found := pattern.match(token):
        words.append(found[1])
        token = token[found.end() :]
    return words, token


def peel(token: str) -> list[str]:
    """A token as common words, stem, common words. The stem has two characters at least; a common word is its own stem."""
    if token in _COMMON:
        return [token]
    first, rest = _eat(_AHEAD, token)
    last, stem = _eat(_BEHIND, rest[::-1])
    return first + [x[::-1] for x in [stem, *reversed(last)]]


def says_something(word: str) -> bool:
    return any(c.isalnum() for c in word)


def split(text: str) -> list[str]:
    """The words of a query as they are written; marks alone are none."""
    seen = unicodedata.normalize("NFKC", UNSEEN.sub("", text))
    return [word for part in _GAP.split(seen.strip()) if says_something(part) for word in peel(part) if says_something(word)]


def analyse(text: str) -> Query:
    roles: dict[str, int] = {}  # 0: common or a number, 1: a kind or a season of something, 2: its name
    for word in map(str.casefold, split(text)):
        common = word in _COMMON or word.isdigit()
        roles[word] = 0 if common else 1 if word in X.CATEGORIES or re.fullmatch(X.SEASON, word) else 2
    at_least = lambda role: tuple(w for w, r in roles.items() if r >= role)
    return Query(at_least(0), at_least(1), at_least(2) or at_least(1))


def relaxed(text: str) -> list[str]:
    """The first usable token, and the usable rest: asked too, but weighed down."""
    tokens = split(text)
    if len(tokens) < 2:
        return []
    good = [t for t in tokens if len(t) > 1 and says_something(t) and not t.isdigit() and t.casefold() not in _COMMON]
    tail = " ".join(t for t in good[1:])
    return [q for q in distinct([*good[:1], tail]) if q and q != text]


def aliases(text: str) -> list[str]:
    low = text.casefold()
    return [q for q in distinct(low.replace(name, other) for name, others in X.ALIASES.items() if name in low for other in others) if q != low]


def plan(text: str) -> list[tuple[str, bool]]:
    """All forms of a query and whether they are relaxed."""
    asked = [(text, False), *((q, False) for q in aliases(text)), *((q, True) for q in relaxed(text))]
    return list({q: (q, r) for q, r in reversed(asked)}.values())[::-1]


def verticals(text: str, most: int = 3) -> list[str]:
    low = text.casefold()
    scores = {v: sum(1 + len(w) / 10 for w in set(words) if w in low) for v, words in X.VERTICALS.items()}
    return [v for v, s in sorted(scores.items(), key=lambda x: (-x[1], x[0])) if s > 0][:most]
