"""Configuration: layers and thresholds from YAML, and the template of such a file."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Thresholds:
    dup_ast_min_nodes: int = 25
    dup_callgraph_min_calls: int = 3
    dup_similarity: float = 0.7
    pattern_dominance: float = 0.5
    pattern_min_samples: int = 3
    max_params: int = 5
    max_returns: int = 2
    max_methods_per_type: int = 15
    func_max_lines: int = 60
    max_cognitive_complexity: int = 15
    max_cyclomatic_complexity: int = 10
    max_map_literal_keys: int = 3

    def merged(self, values: dict) -> Thresholds:
        """Positive values override; zero, negative and unknown ones do not."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in (values or {}).items() if k in known and isinstance(v, (int, float)) and v > 0})


@dataclass(frozen=True)
class Config:
    """``layers``: (name, patterns) in order; ``allowed``: layer -> layers that it may import."""

    layers: list[tuple[str, list[str]]] = field(default_factory=list)
    allowed: dict[str, list[str]] = field(default_factory=dict)
    thresholds: Thresholds = Thresholds()


def _pattern(text: str) -> str:
    return text.removeprefix("./").removesuffix("/...")


def load(path: str) -> Config:
    import yaml

    raw = yaml.safe_load(Path(path).read_text()) or {}
    layers = [(x["name"], [_pattern(p) for p in x.get("packages") or []]) for x in raw.get("layers") or []]
    return Config(layers, {x["name"]: list(x.get("allowed_deps") or []) for x in raw.get("layers") or []}, Thresholds().merged(raw.get("thresholds")))


def write_template(path: str) -> None:
    """Write a file with every threshold at its default; an existing file is an error."""
    import yaml

    target = Path(path)
    if target.exists():
        raise FileExistsError(path)
    sample = {"layers": [{"name": "service", "packages": ["./service/..."], "allowed_deps": ["store"]}, {"name": "store", "packages": ["./store/..."], "allowed_deps": []}]}
    target.write_text(yaml.safe_dump(sample | {"thresholds": {f.name: f.default for f in fields(Thresholds)}}, sort_keys=False))
