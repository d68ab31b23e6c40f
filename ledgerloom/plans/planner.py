"""Capabilities, their registry, plans in order of prerequisites, and the policy that allows them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Capability:
    """A named transform with what it needs and what it may touch."""

    name: str
    transform: Callable[[DataFrame], DataFrame]
    prerequisites: tuple[str, ...] = ()
    profiles: frozenset[str] = frozenset({"default"})
    grants: frozenset[str] = frozenset()


@dataclass
class Capabilities:
    known: dict[str, Capability] = field(default_factory=dict)

    def register(self, *items: Capability) -> None:
        """All of ``items`` or, if any name is taken, none."""
        names = [c.name for c in items]
        taken = [n for n in names if n in self.known or names.count(n) > 1]
        if taken:
            raise ValueError(f"registered already: {', '.join(sorted(set(taken)))}")
        self.known.update({c.name: c for c in items})

    def plan(self, wanted: list[str], profile: str = "default", allowed: frozenset[str] = frozenset()) -> list[str]:
        """Names in an order in which every prerequisite comes first; cycles, unknown names, other profiles and grants that
        aren't allowed are refused."""
        order: list[str] = []
        path: list[str] = []

        def visit(name: str) -> None:
            if name in order:
                return
            if name in path:
                raise ValueError("cycle: " + " > ".join([*path[path.index(name) :], name]))
            if name not in self.known:
                raise KeyError(name)
            c = self.known[name]
            if profile not in c.profiles:
                raise ValueError(f"{name} isn't available in profile {profile}")
            if c.grants - allowed:
                raise PermissionError(f"{name} needs {', '.join(sorted(c.grants - allowed))}")
            path.append(name)
            for p in c.prerequisites:
                visit(p)
            path.pop()
            order.append(name)

        for name in wanted:
            visit(name)
        return order

    def run(self, df: DataFrame, wanted: list[str], **how) -> DataFrame:
        for name in self.plan(wanted, **how):
            df = df.transform(self.known[name].transform)
        return df


def paths_overlap(a: str, b: str) -> bool:
    """Whether one path holds the other."""
    x, y = a.rstrip("/") + "/", b.rstrip("/") + "/"
    return x.startswith(y) or y.startswith(x)


def resolve_dpi(profile: str | None, quality: str | None = None) -> int:
    """Scan resolution by profile."""
    return {"fast": 150, "balanced": 200, "accurate": 300}.get((quality or profile or "balanced").lower(), 200)


class Unavailable(RuntimeError):
    """Raised by boundaries without an injected backend."""


def boundary(name: str) -> Callable[..., DataFrame]:
    """A typed place for a model or service that this engine doesn't ship."""

    def missing(*_: object, **__: object) -> DataFrame:
        raise Unavailable(f"{name} needs a backend; pass one in")

    return missing


ocr_pages, translate_texts, read_pdf, read_legacy_doc, fetch_cloud = (boundary(n) for n in ("ocr_pages", "translate_texts", "read_pdf", "read_legacy_doc", "fetch_cloud"))
