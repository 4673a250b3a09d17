"""Names of adapters: a class is known by its name without what kind it is, in lower case."""

from __future__ import annotations

from importlib.metadata import entry_points

#: Endings of class names that say their kind.
ENDINGS = ("LLM", "VectorStore", "Adapter", "Framework", "Evaluator")
KINDS = ("llm", "vectorstore", "framework", "evaluator")


def name_of(cls: type) -> str:
    for ending in ENDINGS:
        if cls.__name__.endswith(ending):
            return cls.__name__[: -len(ending)].lower()
    return cls.__name__.lower()


class Registry:
    def __init__(self):
        self.known: dict[str, tuple[type, str, bool]] = {}

    def add(self, cls: type, kind: str, name: str | None = None) -> str:
        if kind not in KINDS:
            raise ValueError(f"no kind {kind!r}")
        name = (name or name_of(cls)).lower()
        self.known[name] = (cls, kind, bool(getattr(cls, "is_local", False)))
        return name

    def scan(self, group: str = "tessel") -> list[str]:
        """Adds what installed packages offer under ``group.kind``; one that can't be loaded is left out."""
        found = []
        for kind in KINDS:
            for point in entry_points(group=f"{group}.{kind}"):
                try:
                    found.append(self.add(point.load(), kind, point.name))
                except Exception:  # noqa: BLE001  a broken package doesn't hide the others
                    continue
        return found

    def get(self, name: str) -> type:
        if name.lower() not in self.known:
            raise KeyError(f"no adapter {name!r}; there are {', '.join(sorted(self.known)) or 'none'}")
        return self.known[name.lower()][0]

    def names(self, kind: str | None = None, local: bool | None = None) -> list[str]:
        return sorted(n for n, (_, k, own) in self.known.items() if (kind is None or k == kind) and (local is None or own == local))
