"""Query analysis on the driver: what a pattern asks for."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .. import model
from .text import fold_text, token_list


def words(s: str) -> list[str]:
    """Tokens in their own case."""
    return [t for t in re.split(r"[^\w]|_", s) if t]


def is_marked_identifier(s: str) -> bool:
    """One token of two characters or more with an upper-case letter."""
    return words(s) == [s] and len(s) > 1 and any(c.isupper() for c in s)


def is_literal(s: str) -> bool:
    return len(s.split()) == 1 and bool(words(s)) and (any(c in "-_.:/#<>=()\"'`" for c in s) or is_marked_identifier(s))


def anchors(s: str) -> list[str]:
    """Fields of a query of several fields that look structured; a lone one must be in mixed case."""
    fields = s.split()
    if len(fields) < 2:
        return []
    mixed = lambda f: any(c.isupper() for c in f[1:]) and any(c.islower() for c in f)
    found = list(dict.fromkeys(f for f in fields if (len(words(f)) > 1 and any(c in "-_.:/#" for c in f)) or (len(words(f)) == 1 and mixed(f))))[: model.ANCHORS]
    return found if len(found) > 1 or (found and mixed(found[0])) else []


def path_terms(s: str) -> list[str]:
    return list(dict.fromkeys(t.lower() for t in words(s) if len(t) >= 4))[: model.PATH_TERMS]


def camel_parts(token: str) -> list[str]:
    """The lower-case token, then its components at case boundaries."""
    parts = re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+|[^\W_A-Za-z]+", token)
    return list(dict.fromkeys([token.lower(), *(p.lower() for p in parts)]))


def evidence_groups(s: str) -> list[list[str]]:
    seen: dict[str, list[str]] = {}
    for t in words(s):
        seen.setdefault(t.lower(), camel_parts(t))
    return list(seen.values())


def baseline_tokens(s: str) -> list[str]:
    """Tokens of the token-count baseline: three bytes at least, trimmed of punctuation."""
    trimmed = (re.sub(r"^[^\w-]+|[^\w-]+$", "", t) for t in s.lower().split())
    return list(dict.fromkeys(t for t in trimmed if len(t.encode()) >= 3))


def regex_literals(pattern: str) -> list[str]:
    """Tokens of the literal runs of a regular expression, without repeats, in order."""
    import re._parser as parser

    out: list[str] = []

    def walk(node) -> None:
        run = ""
        for op, value in node:
            name = str(op)
            if name == "LITERAL":
                run += chr(value)
                continue
            out.append(run)
            run = ""
            if name == "SUBPATTERN":
                walk(value[-1])
            elif name == "BRANCH":
                for branch in value[1]:
                    walk(branch)
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                walk(value[2])
        out.append(run)

    walk(parser.parse(pattern))
    tokens = [t for run in out for t in words(run)]
    return list({t.lower(): t for t in reversed(tokens)}.values())[::-1]


@dataclass
class Plan:
    """What to search: a lexical clause and, where there is one, a semantic clause, in a scope."""

    pattern: str
    match: str = "text"
    semantic: str = ""
    scope: str = ""
    terms: list[str] = field(default_factory=list)

    @property
    def evidence(self) -> str:
        base = self.pattern if self.match != "regexp" else " ".join(regex_literals(self.pattern))
        return base if self.semantic in ("", base) else f"{base} {self.semantic}"


def plan_query(pattern: str, match: str = "text", about: str = "", scope: str = "") -> Plan:
    """Checks and plans a query; raises ValueError for what can't be searched."""
    pattern, about = pattern.strip(), about.strip()
    if match not in ("text", "fixed", "regexp"):
        raise ValueError(f"no such kind of match: {match}")
    for s, needed in ((pattern, True), (about, False)):
        if needed and not s:
            raise ValueError("the query is empty")
        if len(s.encode("utf-8", "strict")) > model.MAX_QUERY_BYTES or len(s.split()) > model.MAX_QUERY_TERMS:
            raise ValueError("the query is too long")
    if match == "regexp":
        from .text import java_regex

        java_regex(pattern)
        re.compile(pattern)
        literals = regex_literals(pattern)
        return Plan(pattern, match, about or " ".join(literals), scope, literals)
    if match == "text" and not token_list(pattern):
        raise ValueError("the query has no letter or digit")
    return Plan(pattern, match, about or pattern, scope, list(dict.fromkeys(token_list(pattern))))


__all__ = ["Plan", "anchors", "baseline_tokens", "camel_parts", "evidence_groups", "fold_text", "is_literal", "is_marked_identifier", "path_terms", "plan_query", "regex_literals", "words"]
