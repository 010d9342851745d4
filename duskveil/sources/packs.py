"""Rule packs: files of rules with a manifest of versions and activation."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from ..operators.rules import Rule, check_rules


@dataclass
class Pack:
    name: str
    version: str
    rules: list[Rule]
    signature: str | None = None


def load_pack(path: str) -> Pack:
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    body = raw.get("pack", raw)
    return Pack(body["name"], body["version"], [Rule.parse(r) for r in body.get("rules", [])], raw.get("signature"))


def load_packs(folder: str) -> list[Pack]:
    return [load_pack(os.path.join(folder, n)) for n in sorted(os.listdir(folder)) if n.endswith(".json")]


@dataclass
class Registry:
    """Installed versions by name; ``verify`` says whether a pack's signature is trusted (none: unsigned packs are taken)."""

    verify: Callable[[Pack], bool] | None = None
    versions: dict[str, list[Pack]] = field(default_factory=dict)
    active: dict[str, bool] = field(default_factory=dict)

    def install(self, pack: Pack) -> None:
        if self.verify and not self.verify(pack):
            raise ValueError(f"pack {pack.name}: signature is not trusted")
        check_rules(pack.rules)
        self.versions.setdefault(pack.name, []).append(pack)
        self.active[pack.name] = True

    def rollback(self, name: str) -> Pack:
        installed = self.versions.get(name, [])
        if len(installed) < 2:
            raise ValueError(f"pack {name} has no version before")
        installed.pop()
        return installed[-1]

    def uninstall(self, name: str) -> None:
        if name not in self.versions:
            raise ValueError(f"pack {name} is not installed")
        del self.versions[name], self.active[name]

    def set_active(self, name: str, on: bool) -> None:
        if name not in self.versions:
            raise ValueError(f"pack {name} is not installed")
        self.active[name] = on

    def rules(self, base: list[Rule]) -> list[Rule]:
        """Base rules, then those of active packs by (name, version) as text; repeats are kept."""
        packs = sorted((v[-1] for n, v in self.versions.items() if self.active[n]), key=lambda p: (p.name, p.version))
        return [*base, *(r for p in packs for r in p.rules)]
