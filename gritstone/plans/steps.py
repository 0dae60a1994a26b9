"""Pipelines of named steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gritstone.sources.scratch import cut_lineage


@dataclass
class Context:
    seed: str
    log: list[dict] = field(default_factory=list)


@dataclass(frozen=True)
class Step:
    """A name and ``apply(df, ctx)``, which gives the new table, or the table and whether it is changed. ``when`` may leave the step out."""

    name: str
    apply: Callable[[DataFrame, Context], DataFrame | tuple[DataFrame, bool]]
    when: Callable[[DataFrame], bool] | None = None


def build_steps(names: str, registry: dict[str, Step], aliases: dict[str, str] | None = None) -> list[Step]:
    """Steps from a comma list; blanks and empty names are skipped, unknown names raise."""
    out = []
    for raw in names.split(","):
        name = raw.strip()
        if not name:
            continue
        name = (aliases or {}).get(name, name)
        if name not in registry:
            raise ValueError(f"unknown step: {name}")
        out.append(registry[name])
    return out


def run_pipeline(df: DataFrame, steps: list[Step], seed: str, on_error: str = "raise") -> tuple[DataFrame, list[tuple[str, Observation, Observation]], Context]:
    """The table after all steps, and for each step the observed rows before and after; they count along with the query itself.

    on_error ``skip``: a step that fails, while it is planned or while it runs, is logged and leaves the table
    unchanged; each step is run and written to the shared folder for that. A step that says it changed nothing keeps the table.
    """
    ctx, seen = Context(seed), []
    for no, step in enumerate(steps):
        if step.when is not None and not step.when(df):
            ctx.log.append({"step_no": no, "name": step.name, "kind": "skipped"})
            continue
        ctx.log.append({"step_no": no, "name": step.name, "kind": "start"})
        before, after = Observation(f"{no}-before"), Observation(f"{no}-after")
        try:
            new = step.apply(df.observe(before, F.count(F.lit(1)).alias("rows")), ctx)
            new, changed = new if isinstance(new, tuple) else (new, True)
            new = new.observe(after, F.count(F.lit(1)).alias("rows"))
            new.schema  # a step that cannot be planned fails here
            if on_error == "skip":
                new = cut_lineage(new)
            df = new
            seen.append((step.name, before, after))
            ctx.log.append({"step_no": no, "name": step.name, "kind": "end", "changed": changed})
        except Exception as e:
            ctx.log.append({"step_no": no, "name": step.name, "kind": "error", "message": str(e)[:200]})
            if on_error != "skip":
                raise
    return df, seen, ctx


def step_log(counts: DataFrame) -> DataFrame:
    """Step log rows (run_id, step_no, name, rows_before, rows_after) with delta and changed."""
    return counts.withColumn("delta", F.col("rows_after") - F.col("rows_before")).withColumn("changed", F.col("rows_after") != F.col("rows_before"))
