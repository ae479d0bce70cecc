"""Registry of reply models, and the choice of the ones to run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The model families that are compared, and the mark of a path still to be set.
FAMILIES = ["qwen", "llama", "phi", "mistral", "granite", "gemma", "falcon"]
UNSET_PATH = "CHANGE_ME"


@dataclass(frozen=True)
class ModelSpec:
    model_name: str
    model_family: str
    model_type: str
    backend: str = "builtin"
    model_path: str = ""


def default_specs(paths: dict[str, str] | None = None) -> list[ModelSpec]:
    """A base and a fine-tuned model per family, and one hosted model."""
    paths = paths or {}
    specs = []
    for family in FAMILIES:
        for suffix, kind in (("base", "base"), ("finetuned", "fine_tuned")):
            name = f"{family}_{suffix}"
            path = paths.get(name, f"{UNSET_PATH}/{name}")
            specs.append(ModelSpec(name, family, kind, "local_unsloth", path))
    return [*specs, ModelSpec("gemini_2_5_flash", "gemini", "api", "gemini", "gemini-2.5-flash")]


def select_models(specs: list[ModelSpec], names: list[str] | None) -> list[ModelSpec]:
    """The named models in registry order, all when no names are given."""
    chosen = [s for s in specs if not names or s.model_name in names]
    if not chosen:
        raise ValueError("No models selected.")
    return chosen


def skip_unconfigured(specs: list[ModelSpec]) -> list[ModelSpec]:
    """Without local models whose path is still to be set."""
    return [
        s for s in specs
        if not (s.backend == "local_unsloth" and s.model_path.startswith(UNSET_PATH))
    ]


def spec_array(specs: list[ModelSpec]) -> Column:
    """The registry as an array column, so that a grid needs no join."""
    return F.array(
        *[F.struct(*[F.lit(v).alias(n) for n, v in vars(s).items()]) for s in specs]
    )


def case_model_grid(cases: DataFrame, specs: list[ModelSpec]) -> DataFrame:
    """Every row once per model, with the model's columns."""
    return cases.select("*", F.explode(spec_array(specs)).alias("_m")).select(
        *cases.columns, "_m.*"
    )
