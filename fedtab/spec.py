"""Table description and the fixed values of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values -------------------------------------------------------------------------
ARMS = (
    "isolated_real", "isolated_augmented",
    "federated_real", "federated_augmented",
    "centralized_real", "centralized_augmented",
)
METRICS = ("precision", "recall", "f1", "auc", "accuracy")
MODE_STATISTICAL = "augment_ctgan"
MODE_AGGREGATE = "schema_llm"
MODE_LABEL = {MODE_STATISTICAL: "Augment (CTGAN)", MODE_AGGREGATE: "Schema (LLM)"}
VERDICT_LABEL = {
    "PASS": "Passed",
    "REJECT_TOO_FEW_ROWS": "Rejected (too few valid rows)",
    "REJECT_FIDELITY": "Rejected (fidelity below floor)",
    "REJECT_NOVELTY": "Rejected (novelty below floor)",
    "REJECT_MODE_COLLAPSE": "Rejected (mode collapse)",
}
RUN_DEFAULTS = {"seed": 42, "epochs": 20, "num_rounds": 10, "local_epochs": 2}
GATE_LIMITS = {"fidelity_floor": 0.5, "novelty_floor": 0.95, "mode_collapse_ceiling": 0.998, "min_valid_rows": 5}
CLIENT_WEIGHTS = {"A": 0.35, "B": 0.35, "C": 0.15, "D": 0.15}
RICH_CLIENTS = ("A", "B")
SKEW_ALPHA, POOR_CAP, SPLIT_SEED = 0.3, 15, 42
POOLED = "*"  # client name of the pooled (centralized) scaler and model
# -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TableSpec:
    """Names the columns of a transaction table; no operator hard-codes them.

    ``key`` feeds the sampling hash, ``ties`` orders rows whose hash and key agree. Key and ties
    together must tell all rows apart.
    """

    features: tuple[str, ...]
    key: tuple[str, ...]
    label: str = "label"
    client: str = "client"
    ties: tuple[str, ...] = ()


@dataclass(frozen=True)
class Thresholds:
    """Gate limits, frozen once an arm has been evaluated."""

    fidelity_floor: float = GATE_LIMITS["fidelity_floor"]
    novelty_floor: float = GATE_LIMITS["novelty_floor"]
    mode_collapse_ceiling: float = GATE_LIMITS["mode_collapse_ceiling"]
    min_valid_rows: int = GATE_LIMITS["min_valid_rows"]


@dataclass(frozen=True)
class PartitionPlan:
    """How the training pool is spread over the clients."""

    clients: tuple[str, ...] = tuple(CLIENT_WEIGHTS)
    rich: tuple[str, ...] = RICH_CLIENTS
    weights: dict[str, float] = field(default_factory=lambda: dict(CLIENT_WEIGHTS))
    alpha: float = SKEW_ALPHA
    poor_cap: int = POOR_CAP
    seed: int = SPLIT_SEED
