"""The search grammar: bare words, site:, filetype:, "phrases" (also in Chinese quotes), * and ?, /regular expressions/."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_PART = re.compile(r'"([^"]*)"|“([^”]*)”|/((?:[^/\\]|\\.)+)/|(?:(site|filetype):(\S+))|(\S+)', re.I)
_HAN = re.compile(r"[㐀-鿿]+")


@dataclass
class ParsedQuery:
    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    wildcards: list[str] = field(default_factory=list)
    regexes: list[str] = field(default_factory=list)
    site: str | None = None
    filetype: str | None = None


def words(text: str) -> list[str]:
    """Tokens as the index has them: lower-cased runs; Han runs as single characters and bigrams."""
    out: list[str] = []
    for run in re.findall(r"[^\W_]+", text.lower()):
        at = 0
        for han in _HAN.finditer(run):
            if han.start() > at:
                out.append(run[at : han.start()])
            r = han.group()
            out += [*r, *(r[i : i + 2] for i in range(len(r) - 1))]
            at = han.end()
        if at < len(run):
            out.append(run[at:])
    return out


def parse(query: str, site: str | None = None, filetype: str | None = None) -> ParsedQuery:
    """Bare words are alternatives; all other parts must hold. site and filetype stand for the form's fields."""
    out = ParsedQuery(site=site, filetype=filetype)
    for quoted, chinese, regex, key, value, word in _PART.findall(query):
        if quoted or chinese:
            out.phrases.append(quoted or chinese)
            out.terms += words(quoted or chinese)
        elif regex:
            re.compile(regex)
            out.regexes.append(regex)
        elif key:
            setattr(out, key.lower(), value)
        elif "*" in word or "?" in word:
            out.wildcards.append(word)
        else:
            out.terms += words(word)
    return out
