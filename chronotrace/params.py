"""Parameter sets of the operators. The defaults are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SegmentationParams:
    appearance_weight: float = 0.8
    motion_weight: float = 0.2
    time_decay: float = 0.05
    block: int = 500
    first_k: int = 5
    min_k: int = 3
    propagation_steps: int = 1
    smooth_seconds: float = 2.0
    mad_multiplier: float = 3.0
    min_gap_seconds: float = 2.0
    band: int = 10
    band_k: int = 5


@dataclass(frozen=True)
class TrackerParams:
    similarity: float = 0.72
    max_age_frames: int = 150
    max_active: int | None = None  # where set, the entity met longest ago makes room
    min_energy_new: float = 0.06
    exempt_classes: tuple[str, ...] = (
        "person", "fire", "smoke", "knife", "gun", "explosion", "blood", "bat", "hammer", "crowbar",
    )


@dataclass(frozen=True)
class PoolParams:
    similarity: float = 0.55
    max_age: int = 60
    max_size: int | None = None  # where set, the fifth met longest ago makes room
    ema_alpha: float = 0.3


@dataclass(frozen=True)
class TriggerParams:
    jump: float = 0.22
    heartbeat: float = 3.0
    min_gap_frames: int = 5
    frames_per_unit: float = 1.0  # the fewest frames in one unit of time; less than true is safe

    @property
    def reach(self) -> float:
        """Time after which a sample matters no more: the heartbeat or the frame gap, whichever is longer."""
        return max(self.heartbeat, self.min_gap_frames / self.frames_per_unit)


@dataclass(frozen=True)
class GlobalHeartbeatParams:
    interval: float = 4.0
    drift: float = 0.18


@dataclass(frozen=True)
class DiscordanceParams:
    sigma: float = 5.0
    floor: float = 0.20
    danger_ceiling: float = 0.10
    excess: float = 3.5
    drift: float = 0.20
    vote_ratio: float = 0.35
    vote_min: int = 2
    warmup_rows: int = 30
    burst_margin: float = 2.0


@dataclass(frozen=True)
class GraphParams:
    max_nodes: int = 100
    min_nodes_for_audit: int = 1
    max_edge_gap: float = 30.0
    portrait_weight: float = 0.4
    action_weight: float = 0.6
    portrait_similarity: float = 0.8


@dataclass(frozen=True)
class AuditParams:
    max_entities: int = 12
    danger_gate: float = 0.2
    drift_gate: float = 0.25
    confidence: float = 0.5
    film_factor: float = 0.7
    saturation_confidence: float = 0.95


@dataclass(frozen=True)
class LocalizerParams:
    shift: float = 0.4
    window: int = 3
    slope: float = 0.05
    radius: float = 2.0
    min_len: float = 1.0
    max_len: float = 300.0
    pad: float = 4.0


@dataclass(frozen=True)
class SamplerParams:
    base_fps: float = 0.5
    max_fps: float = 3.0
    low: float = 0.02
    high: float = 0.15
    window: int = 5


@dataclass(frozen=True)
class FusionParams:
    path: float = 0.30
    edge: float = 0.25
    breakage: float = 0.30
    energy: float = 0.15
    ema_alpha: float = 0.3
    min_path: int = 3
    threshold: float = 0.7


@dataclass(frozen=True)
class BoxFusionParams:
    merge_iou: float = 0.3
    detector_only_conf: float = 0.20
    motion_only_energy: float = 0.04
