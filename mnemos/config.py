"""Constants of the jobs, as frozen values passed to them."""

from __future__ import annotations

from dataclasses import dataclass

SOURCES = ("user", "assistant", "tool", "env")
PAYLOAD_TYPES = ("text", "tool_call", "tool_result", "state_delta", "reward", "observation")
ACTIONS = ("ASSIMILATE", "ATTACH", "SPLIT", "BIRTH", "INHIBIT")
EDGE_KIND_COST = {"assoc": 0.90, "temporal": 1.00, "inhib": 1.10, "option": 1.15}
EPS = 1e-8
SCHEMA_VERSION = 6


@dataclass(frozen=True)
class FieldConfig:
    """Fixed values that results depend on."""

    latent_dim: int = 128
    packet_chars: int = 512
    candidate_size: int = 64
    workspace_size: int = 12
    frontier_size: int = 16
    settle_steps: int = 8
    settle_eta: float = 0.35
    evidence_decay: float = 0.995
    eta_mu: float = 0.20
    eta_ctx: float = 0.10
    eta_sigma: float = 0.10
    eta_stability: float = 0.05
    lambda_stability: float = 4.0
    lambda_storage: float = 0.05
    lambda_complexity: float = 0.03
    lambda_fidelity: float = 0.05
    lambda_role: float = 0.03
    kappa_evidence: float = 0.3
    kappa_pred: float = 0.8
    base_trace_cost: float = 1.0
    base_edge_cost: float = 0.1
    null_sigma: float = 1.20
    sigma_floor: float = 1e-4
    sigma_ceiling: float = 16.0
    edge_decay: float = 0.95
    inhibit_margin: float = 0.15
    predictor_context_weight: float = 0.25
    frontier_context_weight: float = 0.35
    cue_context_weight: float = 1.0
    active_role_threshold: float = 0.75
    reservoir_size: int = 8
    continuation_decay: float = 0.97
    continuation_group_decay: float = 0.98
    objective_local_window: int = 12
    fidelity_min: float = 0.15
    fidelity_compress_step: float = 0.20
    fidelity_expand_step: float = 0.15
    fidelity_sigma_inflate: float = 1.25
    fidelity_prune_floor: float = 0.22
    fidelity_keep_ratio: float = 0.50
    role_support_decay: float = 0.98
    role_gain_decay: float = 0.95


@dataclass(frozen=True)
class ReplayConfig:
    prototype_support: float = 6.0
    prototype_dispersion: float = 0.30
    prototype_gain: float = 0.05
    procedure_support: float = 5.0
    procedure_success: float = 0.70
    procedure_entropy: float = 0.80
    procedure_gain: float = 0.05
    power_pred: float = 1.0
    power_uncertainty: float = 0.8
    power_group: float = 0.5
    power_centrality: float = 0.4
    power_forget: float = 0.4


@dataclass(frozen=True)
class BudgetConfig:
    max_traces: float = 4096
    max_edges: float = 8192
    max_groups: float = 512
    prune_fraction: float = 0.10


FIELD, REPLAY, BUDGET = FieldConfig(), ReplayConfig(), BudgetConfig()
