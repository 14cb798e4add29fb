"""Layered configuration, manifests and profile files: small documents on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from pathlib import Path
from typing import Any

from trellium.sources.files import canonical_hash, markdown_table

#: What a manifest records without its being compared.
RECORDED = (
    "backend", "checkpoint", "endpoint", "served_model", "dtype", "quantization", "speculative_decoding", "kv_budget", "max_num_seqs",
    "max_num_batched_tokens", "chunked_prefill", "prefix_caching", "library_versions", "checkpoint_revision", "adapter_revision",
)
WORDS = {"true": True, "1": True, "yes": True, "on": True, "false": False, "0": False, "no": False, "off": False}


def load(path: str) -> dict[str, Any]:
    """A YAML or JSON mapping; an empty file is empty, anything else an error."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        found = json.loads(text) if text.strip() else None
    else:
        import yaml

        found = yaml.safe_load(text)
    if found is not None and not isinstance(found, dict):
        raise ValueError(f"no mapping at the top of {path}")
    return found or {}


def _leaves(tree: Mapping[str, Any], at: tuple[str, ...] = ()) -> Iterable[tuple[tuple[str, ...], Any]]:
    for name, value in tree.items():
        if isinstance(value, Mapping) and value:
            yield from _leaves(value, (*at, name))
        else:
            yield (*at, name), value


def _put(tree: dict[str, Any], path: Sequence[str], value: Any) -> dict[str, Any]:
    here = tree
    for name in path[:-1]:
        if not isinstance(here.get(name), dict):
            here[name] = {}
        here = here[name]
    if not (value == {} and isinstance(here.get(path[-1]), dict)):
        here[path[-1]] = value
    return tree


def layered(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """One tree of all layers: later leaves win, lists and scalars are replaced whole."""
    return reduce(lambda tree, leaf: _put(tree, *leaf), (leaf for layer in layers for leaf in _leaves(layer)), {})


def override(spec: str, types: Mapping[str, str]) -> dict[str, Any]:
    """The tree of ``a.b=value``; ``types`` gives bool, int, float, str or list of each dotted key, ``?`` for one that may be null."""
    key, found, raw = spec.partition("=")
    key = ".".join(p for p in key.strip().split(".") if p)
    if not found or key not in types:
        raise ValueError(f"no such setting: {spec!r}")
    kind, optional = types[key].rstrip("?"), types[key].endswith("?")
    return _put({}, key.split("."), None if optional and raw.lower() in ("null", "none") else _read(raw, kind))


def _read(raw: str, kind: str) -> Any:
    if kind == "bool":
        if raw.strip().lower() not in WORDS:
            raise ValueError(f"no boolean: {raw!r}")
        return WORDS[raw.strip().lower()]
    if kind == "list":
        return [x for x in map(str.strip, raw.split(",")) if x]
    return {"int": int, "float": float, "str": str}[kind](raw)


def unknown(tree: Mapping[str, Any], types: Mapping[str, str]) -> list[str]:
    """The dotted keys that ``types`` does not have, sorted."""
    return sorted(k for k in (".".join(p) for p, _ in _leaves(tree)) if k not in types)


def resolve(types: Mapping[str, str], budgets: Mapping[str, Any], base: Mapping[str, Any], profile: Mapping[str, Any], overrides: Sequence[str] = ()) -> dict[str, Any]:
    """Budgets, base, profile and overrides, the later winning; unknown keys and values above a budget are errors."""
    tree = layered(budgets, base, profile, *[override(s, types) for s in overrides])
    if bad := unknown(tree, types):
        raise ValueError(f"unknown settings: {', '.join(bad)}")
    have = {".".join(p): v for p, v in _leaves(tree)}
    caps = {".".join(p): v for p, v in _leaves(budgets)}
    if over := [f"{k}={have[k]} exceeds {c}" for k, c in caps.items() if isinstance(c, int) and isinstance(have[k], int) and have[k] > c]:
        raise ValueError("; ".join(over))
    return tree


def manifest(compared: Mapping[str, Any], recorded: Mapping[str, Any]) -> dict[str, Any]:
    """What must agree between runs, with its hash, and what is only recorded, nulls filled in."""
    return {"invariant": dict(compared), "recorded_free": dict.fromkeys(RECORDED) | dict(recorded), "invariant_hash": canonical_hash(dict(compared))}


def workload_manifest(hashes: Mapping[str, str], categories: Iterable[str], settings: Mapping[str, Any]) -> dict[str, Any]:
    """The sorted categories with exactly one file hash each, the settings, and a hash of all that."""
    wanted = sorted(set(categories))
    if sorted(hashes) != wanted:
        raise ValueError(f"hashes of {sorted(hashes)} for categories {wanted}")
    body = {"categories": wanted, "sha256": dict(hashes), **settings}
    return body | {"manifest_hash": canonical_hash(body)}


def profile_yaml(values: Mapping[str, Any], notes: Sequence[str] = ()) -> str:
    """A flat profile with its provenance as comments; floats to two places."""

    def scalar(x: Any) -> str:
        return "null" if x is None else str(x).lower() if isinstance(x, bool) else f"{x:.2f}" if isinstance(x, float) else str(x)

    return "".join(f"# {n}\n" for n in notes) + "".join(f"{k}: {scalar(v)}\n" for k, v in values.items())


def sweep_report(title: str, sections: Mapping[str, list[dict]], findings: Sequence[str] = ()) -> str:
    """A Markdown report with a table per section, an empty one saying so, and the findings as a list."""
    parts = [f"# {title}\n"]
    for name, rows in sections.items():
        parts.append(f"## {name}\n\n" + (markdown_table(rows, list(rows[0])) if rows else "None.\n"))
    if findings:
        parts.append("## Findings\n\n" + "".join(f"- {f}\n" for f in findings))
    return "\n".join(parts)


def findings(pairs: Sequence[Mapping[str, Any]], base: str, new: str, metric: str) -> list[str]:
    """What the matched pairs (uplift in percent) say, computed from them."""
    from statistics import median

    gains = [p["uplift"] for p in pairs if p["uplift"] is not None]
    if not gains:
        return [f"No point was measured with both {base} and {new}."]
    better = sum(g > 0 for g in gains)
    return [
        f"{new} has more {metric} than {base} at {better} of {len(gains)} matched points.",
        f"The median change is {median(gains):+.2f}%, from {min(gains):+.2f}% to {max(gains):+.2f}%.",
    ]


def report(categories: list[dict], exact: bool = True) -> tuple[str, str]:
    """The JSON and the Markdown of an evaluation: metrics by category, exact success only where it is reported."""
    kept = [c for c in categories[0] if exact or c != "exact_success_rate"] if categories else []
    rows = [{k: r.get(k) for k in kept} for r in categories]
    return json.dumps({"categories": rows}, sort_keys=True, indent=2), markdown_table(rows, kept) if rows else "None.\n"
