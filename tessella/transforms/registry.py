"""Names of transforms, and how configurations become functions on feature sets."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from tessella.features import FeatureSet, Transform, merge_context

NAMES: dict[str, Callable[[Mapping[str, Any]], Transform]] = {}


def transform(*names: str) -> Callable:
    """Register a builder that takes a configuration and gives a function on feature sets."""

    def add(builder: Callable[[Mapping[str, Any]], Transform]) -> Callable:
        for n in names:
            NAMES[n] = builder
        return builder

    return add


def build(config: Mapping[str, Any], key: str | None = None) -> Transform:
    """The transform that ``config[key]`` (or ``config`` itself) describes. Unknown names and missing keys raise here,
    before any data is read. Entries of a list may be names of other sections of ``config``."""
    section = config[key] if key is not None else config
    name = section["transform"]
    if name == "list":
        return build_list([build(config, t) if isinstance(t, str) else build(t) for t in section["transforms"]])
    if name not in NAMES:
        raise KeyError(f"no transform is called {name!r}")
    return NAMES[name](section)


def build_list(parts: list[Transform]) -> Transform:
    """One after the other, each on what the ones before it gave."""
    return lambda fs: reduce(lambda acc, t: t(acc), parts, fs)


class Transformer:
    """Context, item and combined transforms of a model. The context is transformed once an example, before it is
    joined to the example's items."""

    def __init__(self, config: Mapping[str, Any], key: str | None = None):
        section = config[key] if key is not None else config
        whole = {**config, **section}
        part = lambda n: build(whole, section[n]) if isinstance(section.get(n), str) else build(section[n]) if section.get(n) else (lambda fs: fs)
        self.context, self.item, self.combined = part("context_transform"), part("item_transform"), part("combined_transform")

    def __call__(self, items: FeatureSet, context: FeatureSet | None = None, on: list[str] | None = None) -> FeatureSet:
        items = self.item(items)
        if context is not None:
            items = merge_context(self.context(context), items, on or [])
        return self.combined(items)
