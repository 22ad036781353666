"""Weights and thresholds of all scores."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """The scores are defined by these constants."""

    person_name: float = 0.30
    person_phonetic: float = 0.15
    person_dob: float = 0.20
    person_phone: float = 0.20
    person_vehicle: float = 0.10
    person_location: float = 0.05
    resolve_high: float = 0.80
    resolve_possible: float = 0.55
    sim_mo: float = 0.25
    sim_category: float = 0.15
    sim_legal: float = 0.10
    sim_geo: float = 0.15
    sim_time: float = 0.10
    sim_person: float = 0.15
    sim_vehicle: float = 0.05
    sim_phone: float = 0.05
    geo_decay_km: float = 10.0
    time_decay_days: float = 30.0
    sim_high: float = 0.75
    sim_moderate: float = 0.50
    link_weights: dict[str, float] = field(
        default_factory=lambda: {
            "SHARED_HIGH_CONFIDENCE_PERSON": 1.00,
            "SHARED_PHONE": 0.90,
            "SHARED_VEHICLE": 0.85,
            "SIMILAR_MODUS_OPERANDI": 0.60,
            "SHARED_LOCATION": 0.50,
            "POSSIBLE_PERSON_RELATIONSHIP": 0.45,
            "TEMPORAL_PROXIMITY": 0.35,
            "SIMILAR_CRIME_CATEGORY": 0.25,
            "SIMILAR_LEGAL_SECTIONS": 0.15,
        }
    )
    link_default: float = 0.20
    link_very_high: float = 0.85
    link_high: float = 0.70
    link_moderate: float = 0.50
    link_low: float = 0.25


DEFAULT = Settings()
