"""Registered sources: one spec and one normaliser each, uniform lineage on every row.

Fetching is not done here; a normaliser starts from landed rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpanel.functions.text import row_hash
from marketpanel.schemas import SOURCE_ROLES

Normaliser = Callable[[DataFrame], DataFrame]
REQUIRED = ("transaction_date", "market_code", "crop_code", "row_hash", "source_id")


@dataclass(frozen=True)
class SourceSpec:
    source_id: str
    source_url: str
    source_role: str
    dataset_semantics: str
    precedence: int
    adapter_version: str
    source_schema_version: str

    def __post_init__(self):
        if self.source_role not in SOURCE_ROLES:
            raise ValueError(f"unknown source role {self.source_role}")
        if not all(v.strip() for v in (self.source_id, self.dataset_semantics, self.adapter_version)):
            raise ValueError("source spec fields must not be blank")


class SourceRegistry:
    """Normalisers by source id."""

    def __init__(self):
        self._known: dict[str, tuple[SourceSpec, Normaliser]] = {}

    def register(self, spec: SourceSpec) -> Callable[[Normaliser], Normaliser]:
        if spec.source_id in self._known:
            raise ValueError(f"source {spec.source_id} is registered twice")

        def keep(normaliser: Normaliser) -> Normaliser:
            self._known[spec.source_id] = (spec, normaliser)
            return normaliser

        return keep

    def observations(self, landed: Mapping[str, DataFrame]) -> DataFrame:
        """Union of all sources, each row with its spec and batch lineage."""
        parts = []
        for source_id, rows in landed.items():
            spec, normaliser = self._known[source_id]
            out = normaliser(rows)
            missing = [c for c in REQUIRED if c not in out.columns]
            if missing:
                raise ValueError(f"source {source_id} lacks {', '.join(missing)}")
            parts.append(with_lineage(out, spec))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_lineage(rows: DataFrame, spec: SourceSpec) -> DataFrame:
    return rows.withColumns({
        "source_role": F.lit(spec.source_role),
        "dataset_semantics": F.lit(spec.dataset_semantics),
        "source_precedence": F.lit(spec.precedence),
        "adapter_version": F.lit(spec.adapter_version),
        "source_schema_version": F.lit(spec.source_schema_version),
    })


def lineage_rules(spec: SourceSpec, start: Column, end: Column) -> list[tuple[str, Column]]:
    """Row rules of a batch: its own source, and dates inside the requested range."""
    return [
        ("foreign_source", F.col("source_id") != spec.source_id),
        ("outside_requested_range", ~F.col("transaction_date").between(start, end)),
    ]


def request_id(source_id: Column, start: Column, end: Column, content_hash: Column, adapter_version: Column, schema_version: Column) -> Column:
    """Identity of a run by what was asked for and what came: a pull of other content, or read by another version of
    the adapter or of the source's schema, is another run."""
    return row_hash(source_id, start, end, content_hash, adapter_version, schema_version)


def observation_id(run_id: Column, record_hash: Column, *position: Column) -> Column:
    """Identity of one record of one run, even when two records are equal."""
    return row_hash(run_id, record_hash, *position)


def with_default_provenance(rows: DataFrame, spec: SourceSpec) -> DataFrame:
    """Rows stored before provenance columns existed get the values of their source; rows of any
    other source keep what they have."""
    own = F.col("source_id") == spec.source_id
    defaults = {
        "dataset_semantics": F.lit(spec.dataset_semantics),
        "source_role": F.lit(spec.source_role),
        "source_precedence": F.lit(spec.precedence),
    }
    return rows.withColumns({
        name: F.when(own, F.coalesce(F.col(name), value)).otherwise(F.col(name)) for name, value in defaults.items()
    })
