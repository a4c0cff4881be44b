"""Configurations: JSON and the commonly used part of HOCON (comments, unquoted keys and strings, = or :, dotted keys,
objects that merge, ${references}, newlines for commas, triple quotes), and macros for paths and dates."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Mapping
from typing import Any

_TOKEN = re.compile(r'\s*(?:(#|//)[^\n]*|("""(?:.|\n)*?""")|("(?:\\.|[^"\\])*")|(\$\{\??[^}]+\})|([{}\[\]:=,\n])|([^\s{}\[\]:=,"#$]+(?:[ \t]+[^\s{}\[\]:=,"#$]+)*))')


class Reference(str):
    pass


def _tokens(text: str):
    at = 0
    lines = re.compile(r"[ \t\r]*")
    while at < len(text):
        at = lines.match(text, at).end()
        if at < len(text) and text[at] == "\n":
            yield "\n"
            at += 1
            continue
        m = _TOKEN.match(text, at)
        if not m:
            if text[at:].strip():
                raise ValueError(f"can't read configuration at {text[at : at + 40]!r}")
            return
        at = m.end()
        comment, triple, quoted, ref, sign, word = m.groups()
        if comment:
            continue
        if triple:
            yield ("s", triple[3:-3])
        elif quoted:
            import json

            yield ("s", json.loads(quoted))
        elif ref:
            yield ("r", Reference(ref[2:-1].lstrip("?")))
        elif sign:
            yield sign
        else:
            yield ("w", word)


def _plain(word: str) -> Any:
    if word in ("true", "false"):
        return word == "true"
    if word == "null":
        return None
    for kind in (int, float):
        try:
            return kind(word)
        except ValueError:
            pass
    return word


def _put(into: dict, key: str, value: Any, quoted: bool) -> None:
    *path, last = [key] if quoted else key.split(".")
    for p in path:
        into = into.setdefault(p, {})
    if isinstance(value, dict) and isinstance(into.get(last), dict):
        for k, v in value.items():
            _put(into[last], k, v, True)
    else:
        into[last] = value


def parse(text: str) -> dict[str, Any]:
    tokens = [t for t in _tokens(text)]
    at = 0

    def skip() -> None:
        nonlocal at
        while at < len(tokens) and tokens[at] in ("\n", ","):
            at += 1

    def value() -> Any:
        nonlocal at
        while tokens[at] == "\n":
            at += 1
        t = tokens[at]
        at += 1
        if t == "{":
            return members("}")
        if t == "[":
            out = []
            skip()
            while tokens[at] != "]":
                out.append(value())
                skip()
            at += 1
            return out
        if not isinstance(t, tuple):
            raise ValueError(f"unexpected {t!r} in configuration")
        return _plain(t[1]) if t[0] == "w" else t[1]

    def members(end: str | None) -> dict:
        nonlocal at
        out: dict[str, Any] = {}
        skip()
        while at < len(tokens) and tokens[at] != end:
            if not isinstance(tokens[at], tuple):
                raise ValueError(f"unexpected {tokens[at]!r} in configuration")
            kind, key = tokens[at]
            at += 1
            if tokens[at] in (":", "="):
                at += 1
            _put(out, str(key), value(), kind == "s")
            skip()
        if end:
            at += 1
        return out

    skip()
    whole = tokens[at : at + 1] == ["{"]
    at += whole
    return resolve(members("}" if whole else None))


def lookup(config: Mapping[str, Any], path: str) -> Any:
    for p in path.split("."):
        config = config[p]
    return config


def resolve(config: dict[str, Any]) -> dict[str, Any]:
    """Put referenced values in the place of references."""

    def walk(v: Any) -> Any:
        if isinstance(v, Reference):
            return walk(lookup(config, v))
        if isinstance(v, dict):
            return {k: walk(x) for k, x in v.items()}
        return [walk(x) for x in v] if isinstance(v, list) else v

    return walk(config)


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def date_minus_days(date: str, days: int) -> str:
    return (dt.date.fromisoformat(date) - dt.timedelta(days=int(days))).isoformat()


def dates_between(first: str, last: str) -> list[str]:
    a, b = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    return [(a + dt.timedelta(days=i)).isoformat() for i in range((b - a).days + 1)]


def partitions_by_dates(pattern: str, first: str, last: str) -> list[str]:
    """Paths for every date, put in the place of {date}."""
    return [pattern.replace("{date}", d) for d in dates_between(first, last)]


MACROS: dict[str, Callable] = {
    "max_string": lambda *a: max(a), "min_string": lambda *a: min(a), "sum": lambda *a: sum(map(float, a)),
    "date_minus_days": date_minus_days, "partitions_by_dates": partitions_by_dates,
    "matched_latest_directory": lambda pattern, *names: max((n for n in names if re.fullmatch(pattern, n)), default=None),
}


def expand(config: Any) -> Any:
    """Evaluate {macro: name, args: [...]} objects."""
    if isinstance(config, Mapping):
        if set(config) == {"macro", "args"}:
            return MACROS[config["macro"]](*[expand(a) for a in config["args"]])
        return {k: expand(v) for k, v in config.items()}
    return [expand(v) for v in config] if isinstance(config, list) else config
