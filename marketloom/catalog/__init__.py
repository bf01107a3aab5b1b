"""All registered queries."""

from importlib import import_module
from pkgutil import iter_modules

from .base import ORACLES, QUERIES

for _m in iter_modules(__path__):
    if _m.name != "base":
        import_module(f"{__name__}.{_m.name}")
