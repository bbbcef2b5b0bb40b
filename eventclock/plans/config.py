"""Configuration of a cell: allowed values, artifact key, plain description."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from eventclock.operators import axes, label_kernels, labels, models, sizing

SIZINGS = (*sizing.modes(0.5), "cond_es")
AXES = tuple(axes.AXES)
LABELERS = (*labels.LABELERS, *label_kernels.KERNELS)
#: Feature sets (fixed values).
FEATURES = ("base", "rich", "termstruct", "evt", "disp", "sig", "realyield", "wangrich", "oilbasis", "regime", "vix", "calendar", "ddstate", "iv")


#: Entry thresholds of assets that have their own (fixed values); others enter at 0.45.
THRESHOLDS = {"XLE": 0.10, "QQQ": 0.15, "GLD": 0.35, "HYG": 0.55, "TLT": 0.55}


def default_threshold(ticker: str) -> float:
    return THRESHOLDS.get(ticker, 0.45)


@dataclass(frozen=True)
class CellConfig:
    """Values that are not allowed raise at once."""

    ticker: str
    axis: str
    labeler: str
    thresh: float
    sizing: str
    reduce: str = "correlation"
    features: str = "base"
    model: str = "xgb"
    calibration: str = "isotonic"
    n_components: int = 20
    max_depth: int = 3
    rebal_band: float = 0.01
    horizons: tuple[int, ...] | None = None
    permute_labels: bool = False
    train_purge: bool = False

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(f"{what} of {asdict(self)}")

        need(self.axis in AXES, "axis")
        need(all(p in LABELERS for p in self.labeler.split("+")), "labeler")
        need(self.sizing in SIZINGS, "sizing")
        need(self.reduce in models.REDUCERS, "reduce")
        need(self.features in FEATURES, "features")
        need(self.model in models.MODELS, "model")
        need(self.calibration in models.CALIBRATIONS, "calibration")
        need(0 < self.thresh < 1, "thresh")
        need(5 <= self.n_components <= 60, "n_components")
        need(1 <= self.max_depth <= 8, "max_depth")
        need(0 <= self.rebal_band <= 0.2, "rebal_band")
        least = 1 if self.axis == "sess2" else 2
        need(self.horizons is None or 1 <= len(self.horizons) <= 4 and all(least <= h <= 400 for h in self.horizons), "horizons")

    def suffix(self) -> str:
        """What differs from the defaults, in a fixed order; tokens are fixed values of stored keys."""
        short = {"features": {"rich": "_fr", "termstruct": "_ts", "realyield": "_ry"}, "reduce": {"infogain": "_ig"}, "calibration": {"venn_abers": "_va"}}
        parts = ["_perm" * self.permute_labels]
        if self.n_components != 20:
            parts.append(f"_n{self.n_components}")
        if self.rebal_band != 0.01:
            parts.append(f"_b{round(self.rebal_band * 100)}")
        if self.horizons is not None:
            parts.append("_hz" + "x".join(map(str, self.horizons)))
        for field, default, other in (("reduce", "correlation", "_rd"), ("features", "base", "_fx"), ("calibration", "isotonic", "_cb"), ("model", "xgb", "_m")):
            value = getattr(self, field)
            if value != default:
                parts.append(short.get(field, {}).get(value, other + value))
        parts.append("_tp" * self.train_purge)
        return "".join(parts)

    def key(self) -> str:
        return f"{self.axis}_{self.labeler.replace('+', '_x_')}_{self.sizing}_t{round(self.thresh * 100)}{self.suffix()}"

    def describe(self) -> str:
        parts = " + ".join(p.replace("_", " ") for p in self.labeler.split("+"))
        return f"Sample on {self.axis} bars; label by {'the ensemble of ' if '+' in self.labeler else ''}{parts}; size by {self.sizing.replace('_', ' ')}, entry {self.thresh:.2f}."


#: Blocks of features.py that each feature set adds to the base.
BASE_BLOCKS = ("momentum", "zmomentum", "rolling", "kurtosis", "vol_ratio", "above_ma", "rsi", "bollinger")
BASE_KERNELS = ("sample_entropy",)
ADDED = {"termstruct": ("termstruct",), "oilbasis": ("oilbasis",), "rich": ("variance_ratio",), "calendar": ("calendar",), "ddstate": ("ddstate",), "wangrich": ("differences",), "realyield": ("rate_level",), "vix": ("implied_vol",), "iv": ("implied_vol",)}
ADDED_KERNELS = {"evt": ("evt",), "disp": ("dispersion",), "sig": ("signature",), "regime": ("regime",)}
