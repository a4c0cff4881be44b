"""The transform language: every transform by its name in a configuration."""

from tessella.transforms import dates, floats, quantisers, strings, trees  # noqa: F401
from tessella.transforms.registry import NAMES, Transformer, build, build_list, transform

__all__ = ["NAMES", "Transformer", "build", "build_list", "transform"]
