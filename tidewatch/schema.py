"""Column roles: how a table's columns become the canonical sample columns.

Samples have: source (normal, fault or external), series, t_us (epoch microseconds), seq (order of rows of one time), the
channels, state, idle, and once segmented gap_sec, segment_id, group_id, kind and label.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

SENSOR_CHANNELS = ("AI0_Vibration", "AI1_Vibration", "AI2_Current")
SENSOR_SCHEMA = "TimeStamp string, AI0_Vibration string, AI1_Vibration string, AI2_Current string, Equipment_state string, Idle string"
#: Statistics of each channel in a window, in the order of the feature columns.
STATISTICS = ("mean", "std", "rms", "ptp", "slope")


def feature_names(channels: tuple[str, ...]) -> list[str]:
    """The 16 features of a window over three channels."""
    return [f"{c}_{s}" for c in channels for s in STATISTICS] + [correlation_name(channels)]


def correlation_name(channels: tuple[str, ...]) -> str:
    return f"{channels[0].split('_')[0]}_{channels[1].split('_')[0]}_corr"


@dataclass(frozen=True)
class Roles:
    """SQL expressions over the table's columns for each role."""

    time: str
    channels: dict[str, str]
    series: str = "cast(0 as bigint)"
    seq: str = "cast(0 as bigint)"
    source: str = "'normal'"
    state: str = "0"
    idle: str = "0"


@dataclass(frozen=True)
class Settings:
    """Thresholds in seconds, and the sizes of the detectors (in samples)."""

    gap_sec: float = 0.5
    window_sec: float = 1.0
    step_sec: float = 0.1
    sampling_sec: float = 0.1
    fill: float = 0.8
    short_size: int = 5
    long_size: int = 10
    smooth: int = 3
    persistence: int = 2
    quantile: float = 0.9999
    channels: tuple[str, ...] = field(default=SENSOR_CHANNELS)

    def __post_init__(self):
        above_zero = {"gap_sec": self.gap_sec, "window_sec": self.window_sec, "step_sec": self.step_sec, "sampling_sec": self.sampling_sec}
        wrong = [k for k, v in above_zero.items() if not 0 < v < float("inf")]
        wrong += [k for k, v in {"fill": self.fill, "quantile": self.quantile}.items() if not 0 < v <= 1]
        wrong += [k for k, v in {"short_size": self.short_size, "long_size": self.long_size}.items() if v < 2]
        wrong += [k for k, v in {"smooth": self.smooth, "persistence": self.persistence}.items() if v < 1]
        if wrong or len(self.channels) < 2:
            raise ValueError(f"settings out of range: {', '.join(wrong) or 'channels'}")

    @property
    def min_samples(self) -> int:
        return max(2, int(self.window_sec / self.sampling_sec * self.fill))


def require(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """df, if it has these columns; else an error that names the ones it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


#: Numeric columns that are no features (fixed values).
NOT_FEATURES = frozenset({"sample_count", "actual_duration_sec", "max_gap_sec", "idle_ratio", "idle_majority", "fault_ratio", "label", "segment_id", "split", "window_sec"})


def infer_features(df: DataFrame, prefixes: tuple[str, ...] = ("ai0", "ai1", "ai2"), expect: int | None = 16) -> list[str]:
    """The feature columns by type and name; reads no data."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    found = [c for c, t in df.dtypes if t in numeric and c not in NOT_FEATURES and (c.lower().startswith(prefixes) or "corr" in c.lower())]
    if expect is not None and len(found) != expect:
        raise ValueError(f"{len(found)} feature columns, not {expect}: {found}")
    return found
