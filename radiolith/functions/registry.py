"""Named builders."""

from __future__ import annotations

import importlib


def resolve(path: str):
    """What a dotted path such as ``package.module:name`` (or ``package.module.name``) stands for; models of other libraries come in by it."""
    module, _, name = path.partition(":") if ":" in path else path.rpartition(".")
    if not module or not name:
        raise ValueError(f"{path!r} is no dotted path of a module and a name in it")
    found = importlib.import_module(module)
    for part in name.split("."):
        if not hasattr(found, part):
            raise AttributeError(f"{module} has no {name}")
        found = getattr(found, part)
    return found


class Registry(dict):
    """A dict of builders by name that doesn't take a name twice and says which names there are."""

    def __init__(self, kind: str):
        super().__init__()
        self.kind = kind

    def register(self, name: str):
        def add(item):
            if name in self:
                raise KeyError(f"{self.kind} {name!r} is registered already")
            self[name] = item
            return item

        return add

    def create(self, spec: dict, **more):
        """Call the builder that ``spec['name']`` names, or that ``spec['target']`` is the dotted path of, with ``spec['params']``."""
        if "name" not in spec and "target" not in spec:
            raise KeyError(f"a {self.kind} needs a name")
        build = self[spec["name"]] if "name" in spec else resolve(spec["target"])
        return build(**{**(spec.get("params") or {}), **more})

    def __missing__(self, name):
        raise KeyError(f"unknown {self.kind} {name!r}; there are {sorted(self)}")
