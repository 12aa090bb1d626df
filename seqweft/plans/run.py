"""Run configuration, manifest and artifacts. Survey IDs in brackets."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from seqweft.operators.tokens import POLICIES
from seqweft.schemas import ddl
from seqweft.sources.jsonl import write_preview

# Fixed values of the manifest.
ROLES = ("table", "figure", "preview", "manifest")
FORMATS = ("parquet", "csv", "json", "jsonl", "png", "svg")
STRATEGY_NAMES = ("single", "3-mer", "5-mer", "bpe")


@dataclass(frozen=True)
class RunConfig:
    """Checked when made; nothing falls back in silence [VAL-03, PRJ-08]."""

    data_root: str
    output_root: str
    sample: int | str | None = "all"
    strategies: tuple[str, ...] = STRATEGY_NAMES
    ambiguous_residue_mode: str = "keep"
    rare_residue_policy: str = "keep"
    max_length: int = 512
    bpe_sizes: tuple[int, ...] = (1000, 4000, 8000)

    def __post_init__(self) -> None:
        if not self.data_root or not self.output_root:
            raise ValueError("data_root and output_root are needed")
        if not (self.sample in (None, "all") or (isinstance(self.sample, int) and self.sample > 0)):
            raise ValueError("sample: None, 'all' or a positive number")
        if not self.strategies or set(self.strategies) - set(STRATEGY_NAMES):
            raise ValueError(f"strategies: some of {', '.join(STRATEGY_NAMES)}")
        for name in ("ambiguous_residue_mode", "rare_residue_policy"):
            if getattr(self, name) not in POLICIES:
                raise ValueError(f"{name}: one of {', '.join(POLICIES)}")
        if self.max_length < 1 or any(s < 1 for s in self.bpe_sizes):
            raise ValueError("max_length and bpe_sizes are positive")

    def table(self, spark: SparkSession) -> DataFrame:
        """One row of text values."""
        return spark.createDataFrame([tuple(map(str, asdict(self).values()))], list(asdict(self)))


@dataclass
class Manifest:
    """What a run saved [SNK-14, SNK-17, VAL-06]."""

    config: dict
    artifacts: list[dict] = field(default_factory=list)

    def add(self, name: str, role: str, form: str, path: str, scope: str = "all", view: str = "raw", preview: bool = False) -> None:
        if role not in ROLES or form not in FORMATS:
            raise ValueError(f"role: one of {', '.join(ROLES)}; format: one of {', '.join(FORMATS)}")
        if not name or not path:
            raise ValueError("an artifact has a name and a path")
        self.artifacts.append(dict(zip([c.split()[0] for c in ddl("saved_artifact").split(", ")], (name, role, form, path, scope, view, preview), strict=True)))

    def write(self, path: str) -> None:
        if not self.artifacts:
            raise ValueError("a manifest lists an artifact at least")
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps({"run_date": datetime.now(UTC).isoformat(timespec="seconds"), "config": self.config, "artifacts": self.artifacts}, indent=2), encoding="utf-8")


def save_artifact(df: DataFrame, manifest: Manifest, root: str, name: str, order: list[str], scope: str = "all", view: str = "raw") -> None:
    """The table as Parquet, a preview as CSV, and both in the manifest; views have paths of their own [SNK-17, SNK-18]."""
    path = f"{root}/{view}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path + ".parquet")
    write_preview(df, path + "_preview.csv", order)
    manifest.add(name, "table", "parquet", path + ".parquet", scope, view)
    manifest.add(name + "_preview", "preview", "csv", path + "_preview.csv", scope, view, True)
