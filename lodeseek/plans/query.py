"""Query strings: terms, "phrases", -exclusions and the filters era:, ai: and site:."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from lodeseek.functions.text import ERA_ALIASES, LOWER, STOP_WORDS, UPPER, stem_py

_LOW = str.maketrans(UPPER, LOWER)


@dataclass
class ParsedQuery:
    original: str = ""
    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    era: str | None = None
    max_ai: float | None = None
    min_ai: float | None = None
    site: str | None = None

    def empty(self) -> bool:
        return not self.terms and not self.phrases

    def phrase_words(self) -> list[list[str]]:
        return [[w for w in p.split(" ") if w] for p in self.phrases]

    def scoring_terms(self) -> list[str]:
        """The terms, then the phrases' words; repeated ones count again."""
        return self.terms + [w for words in self.phrase_words() for w in words]

    def __str__(self) -> str:
        said = [("terms", ", ".join(self.terms)), ("phrases", ", ".join(f'"{p}"' for p in self.phrases)), ("excluded", ", ".join(self.excluded)), ("era", self.era), ("max ai", self.max_ai), ("min ai", self.min_ai), ("site", self.site)]
        return "; ".join(f"{k}: {v}" for k, v in said if v not in (None, "")) or "empty"


def normalize_word(word: str) -> str:
    return re.sub("[^A-Za-z0-9]", "", word).translate(_LOW)


def parse_query(text: str, stemming: bool = True, strict_reference: bool = True) -> ParsedQuery:
    """strict_reference=False also takes era:post-ai, which else is read as a term."""
    out = ParsedQuery(text)
    stem = stem_py if stemming else lambda w: w

    def phrase(m: re.Match) -> str:
        if p := m[1].strip(" \t"):
            out.phrases.append(p.translate(_LOW))
        return " "

    rest = re.sub('"([^"]*)"', phrase, text)
    for token in re.split("[ \t\n\r\f\v]+", rest):
        if ":" in token and _filter(token, out, strict_reference):
            continue
        if len(token) > 1 and token[0] == "-":
            if word := stem(normalize_word(token[1:])):
                out.excluded.append(word)
            continue
        word = normalize_word(token)
        if word and word not in STOP_WORDS and (word := stem(word)):
            out.terms.append(word)
    return out


def _filter(token: str, out: ParsedQuery, strict: bool) -> bool:
    key, _, value = token.partition(":")
    key, low = key.translate(_LOW), value.translate(_LOW)
    if key == "era":
        era = ERA_ALIASES.get(low) or (None if strict or low not in ("post-ai", "postai", "post_ai") else "AI_ERA")
        out.era = era or out.era
        return era is not None
    if key == "site" and value:
        out.site = low
        return True
    if key == "ai" and value:
        number = re.match(r"\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", value[1:] if value[0] in "<>" else value)
        if number and 0 <= float(number[0]) <= 1:
            if value[0] == ">":
                out.min_ai = float(number[0])
            else:
                out.max_ai = float(number[0])
            return True
    return False
