"""Typed surface of a model as ``.pyi`` text, for editors."""

from __future__ import annotations

from .model.mapping import Model, method_name


def stub(model: Model) -> str:
    out = ["from entityframe.operators.attributes import *", "from entityframe.operators.finder import Engine, Finder, Related", ""]
    for name, e in model.entities.items():
        body = [f"    def {method_name(p.name)}(self) -> {p.type}Attribute: ...{f'  # {p.doc}' if p.doc else ''}" for p in e.properties]
        body += [f"    def {method_name(k)}(self) -> {j.target}Related: ..." for k, j in model.links[name].items()]
        out += [f"class {name}Related(Related):", *(body or ["    ..."]), "", f"class {name}Finder(Finder, {name}Related): ...", ""]
    out += [f"class {method_name(model.name).title().replace('_', '')}Engine(Engine):", *(f"    {n}: {n}Finder" for n in model.entities)]
    return "\n".join(out) + "\n"
