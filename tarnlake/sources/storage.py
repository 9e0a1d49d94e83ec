"""Where the layers lie: below a local root, or in the containers of a cloud account, by the environment or by hand."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

# Each layer's container and its folder there. Locally a layer is a folder of its own name.
LAYERS = {
    "raw": ("landing", "raw"),
    "incoming": ("landing", "incoming"),
    "processed": ("landing", "processed"),
    "bronze": ("bronze", ""),
    "silver": ("silver", "standardized"),
    "cdc": ("silver", "cdc"),
    "silver_dimensions": ("silver", "dimensions"),
    "enriched_facts": ("silver", "enriched_facts"),
    "gold": ("gold", ""),
    "analytics": ("analytics", ""),
    "scd2_audit": ("audit", "scd2"),
    "validation_audit": ("audit", "validation"),
    "gold_audit": ("audit", "gold"),
    "gold_quality_audit": ("audit", "gold_quality"),
    "fact_enrichment_audit": ("audit", "fact_enrichment"),
    "control": ("audit", "control"),
    "analytics_audit": ("audit", "analytics"),
}
#: What the batch run calls its layers beside those.
OWN = {
    "checked": ("bronze", "checked"),
    "valid": ("bronze", "valid"),
    "quarantine": ("bronze", "quarantine"),
    "changes": ("silver", "changes"),
    "history": ("silver", "history"),
    "enriched": ("silver", "enriched"),
    "marts": ("analytics", "marts"),
    "audit": ("audit", "run"),
    "committed": ("audit", "committed"),
    "stream": ("bronze", "stream"),
}
CONTAINERS = ("landing", "bronze", "silver", "gold", "analytics", "audit")


def joined(base: str | Path, *parts: str | Path | None) -> str:
    """Path parts below a base of any scheme; empty parts are left out."""
    parts = [str(p).strip("/\\") for p in parts if p is not None and str(p).strip()]
    base = str(base)
    if "://" in base or base.startswith("dbfs:/"):
        return "/".join([base.rstrip("/"), *parts])
    return str(Path(base, *parts))


@dataclass(frozen=True)
class Storage:
    mode: str = "local"
    root: str = "data"
    account: str = ""
    containers: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.mode not in ("local", "adls"):
            raise ValueError(f"storage mode {self.mode!r} is neither local nor adls")

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Storage:
        own = {c: env.get(f"ADLS_{c.upper()}_CONTAINER", c).strip() for c in CONTAINERS}
        return cls(
            env.get("STORAGE_MODE", "local").strip().lower(),
            env.get("LOCAL_DATA_ROOT", "data").strip(),
            env.get("ADLS_STORAGE_ACCOUNT", "").strip(),
            own,
        )

    def path(self, layer: str, *parts: str | Path | None) -> str:
        places = LAYERS | OWN
        if layer not in places:
            raise KeyError(f"no layer {layer}; there are {', '.join(sorted(places))}")
        if self.mode == "local":
            return joined(self.root if "://" in self.root else Path(self.root).absolute(), layer, *parts)
        container, folder = places[layer]
        name = self.containers.get(container, container)
        if not name or not self.account:
            raise ValueError("a cloud path needs an account and a container")
        return joined(f"abfss://{name}@{self.account}.dfs.core.windows.net", folder, *parts)
