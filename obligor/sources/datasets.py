"""Registry of named input tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class DatasetConfig:
    """Where a table lives and which column is the target.

    ``source_type`` is any of ``csv``, ``parquet``, ``json``, ``orc`` (read from
    ``path``) or ``table`` (a catalog name in ``path``). The tables known by name have no
    ``path``: whoever holds a copy registers it with ``dataclasses.replace``.
    """

    name: str
    display_name: str
    target_column: str
    source_type: str = "csv"
    path: str | None = None
    target_mapping: Mapping[Any, int] | None = None
    ordinal_mappings: Mapping[str, Sequence[Any]] = field(default_factory=dict)
    ignored_columns: Sequence[str] = ()


# The public tables known by name, with their natural value orders.
BUILTIN = (
    DatasetConfig(
        name="german",
        display_name="UCI German Credit (credit-g)",
        target_column="class",
        target_mapping={"good": 0, "bad": 1},
        ordinal_mappings={
            "checking_status": ["no checking", "<0", "0<=X<200", ">=200"],
            "savings_status": ["no known savings", "<100", "100<=X<500", "500<=X<1000", ">=1000"],
            "employment": ["unemployed", "<1", "1<=X<4", "4<=X<7", ">=7"],
        },
    ),
    DatasetConfig(
        name="give_me_some_credit",
        display_name="Give Me Some Credit",
        target_column="SeriousDlqin2yrs",
        ignored_columns=["Unnamed: 0"],
    ),
    DatasetConfig(
        name="home_credit",
        display_name="Home Credit Default Risk",
        target_column="TARGET",
        ignored_columns=["SK_ID_CURR"],
    ),
)

_registry: dict[str, DatasetConfig] = {config.name: config for config in BUILTIN}


def register_dataset(config: DatasetConfig) -> None:
    """Add a table, replacing one of the same name."""
    _registry[config.name] = config


def registered() -> list[str]:
    return sorted(_registry)


def get_dataset_config(name: str) -> DatasetConfig:
    if name not in _registry:
        raise ValueError(f"Unknown dataset '{name}'. Known datasets: {', '.join(registered())}")
    return _registry[name]
