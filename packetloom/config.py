"""Thresholds of the detections; every operator takes them as a parameter."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    beacon_min_connections: int = 4
    beacon_min_score: int = 40
    confidence_ramp: int = 96
    http_beacon_min_requests: int = 8
    dns_beacon_min_queries: int = 20
    strobe_min_connections: int = 100
    strobe_min_rate: float = 0.5
    exfil_min_mb: float = 5.0
    exfil_ratio: float = 10.0
    off_hours_min_mb: float = 1.0
    off_hours_start: int = 22
    off_hours_end: int = 6
    off_hours_zone: str = "UTC"
    long_conn_min_hours: float = 1.0
    tunnel_label_len: int = 40
    tunnel_entropy: float = 3.5
    tunnel_entropy_min_len: int = 30
    tunnel_min_depth: int = 5
    nxdomain_threshold: int = 200
    unique_subdomain_min: int = 50
    spectral_min_observations: int = 16
    spectral_threshold: float = 14.5
    spectral_rescue: float = 0.5
    dga_entropy: float = 3.5
    dga_bigram: float = -4.5
    persistence_days: int = 7
    series_sample: int = 10_000


DEFAULT = Config()
