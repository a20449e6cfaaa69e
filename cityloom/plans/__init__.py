"""Query plans over the test tables; importing this package registers them all."""

import importlib
import pkgutil

from cityloom.plans.registry import ORACLE_SQL, QUERIES

for _m in pkgutil.iter_modules(__path__):
    if _m.name != "registry":
        importlib.import_module(f"{__name__}.{_m.name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
