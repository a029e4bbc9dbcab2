"""Parameters of a dataset build and the window geometry that follows from them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class BuildConfig:
    """Times are in seconds, as the user gives them; the properties count grid steps of ``step`` seconds.

    A segment begins at row i and has rows [i, i + length): first the observation, then the lead, then the prediction
    rows. The first prediction row is ``leading`` seconds after the last observation row, the last one ``prediction``
    seconds later. With leading 0 the prediction window begins at the last observation row.
    """

    signals: tuple[str, ...] = ("mbp",)
    half_times: tuple[int, ...] = (60, 180, 600)
    step: int = 30
    observation: int = 600
    leading: int = 120
    prediction: int = 480
    shift: int = 30
    min_event: int = 60
    smooth: int = 40
    recovery: int = 600
    threshold: float = 65.0
    low: float = 40.0
    high: float = 150.0
    max_missing: float = 0.2
    how: str = "last"
    not_smoothed: tuple[str, ...] = ("pp_ct",)
    may_miss: tuple[str, ...] = ("mac", "pp_ct")

    def __post_init__(self) -> None:
        if self.step <= 0 or self.obs < 1 or self.n < 1 or self.shift_rows < 1 or self.smooth_rows < 1:
            raise ValueError("observation, min_event, shift and smooth need at least one step")
        if min(self.half_rows, default=2) < 2:
            raise ValueError("a half-time needs at least two steps")
        if max(self.half_rows, default=2) > self.obs:
            raise ValueError("a half-time is longer than the observation")

    @property
    def obs(self) -> int:
        return self.observation // self.step

    @property
    def lead(self) -> int:
        return self.leading // self.step - 1

    @property
    def pred(self) -> int:
        return self.prediction // self.step + 1

    @property
    def length(self) -> int:
        return self.obs + self.lead + self.pred

    @property
    def shift_rows(self) -> int:
        return self.shift // self.step

    @property
    def n(self) -> int:
        return self.min_event // self.step

    @property
    def smooth_rows(self) -> int:
        return self.smooth // self.step

    @property
    def recovery_rows(self) -> int:
        return self.recovery // self.step

    @property
    def half_rows(self) -> tuple[int, ...]:
        return tuple(x // self.step for x in self.half_times)

    def feature_names(self) -> list[str]:
        return [f"{s}_{kind}_{x}" for s in self.signals for x in self.half_times for kind in ("constant", "slope", "std")]

    def model_inputs(self, statics: tuple[str, ...] = ("age", "bmi", "asa"), drop: str = "std_60", exact: bool = False) -> list[str]:
        """Feature names without those that contain ``drop`` (end with it, if exact), and the statics."""
        out = [x for x in self.feature_names() if not (x.endswith(f"_{drop}") if exact else drop in x)]
        return [*out, *statics]

    def to_json(self) -> str:
        """The user-facing values, so that from_json(to_json()) is the same configuration."""
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> BuildConfig:
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()})


THIRTY_SECONDS = BuildConfig(
    signals=("mbp", "sbp", "dbp", "hr", "rr", "spo2", "etco2", "mac", "pp_ct", "rf_ct", "body_temp"), recovery=0, how="median"
)
TWO_SECONDS = BuildConfig(
    signals=("mbp", "sbp", "dbp", "hr", "rr", "spo2", "etco2", "mac", "pp_ct"), half_times=(30, 180, 600), step=2, recovery=0
)
RAW_SIGNALS = BuildConfig(
    signals=TWO_SECONDS.signals, half_times=(10, 60, 300), step=2, observation=300, leading=0, prediction=600
)
