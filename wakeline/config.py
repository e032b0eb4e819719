"""Parameters of the track jobs. All values here are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CleanParams:
    lat: tuple[float, float]
    lon: tuple[float, float]
    sog: tuple[float, float]
    heading: tuple[float, float] = (0.0, 360.0)
    min_entities: int = 3
    max_gap_s: int = 600
    step_s: int = 60
    rolling: int = 5


@dataclass(frozen=True)
class WindowParams:
    observed: int = 10
    predicted: int = 10
    skip: int = 1
    threshold: float = 0.002
    min_entities: int = 1

    @property
    def length(self) -> int:
        return self.observed + self.predicted


@dataclass(frozen=True)
class EvaluationParams:
    """What an evaluation reads and how: frame tables in root/dataset/split, windows, and the minutes of a step."""

    root: str
    dataset: str
    split: str = "test"
    tag: str = "run"
    windows: WindowParams = WindowParams(predicted=5)
    step_minutes: int = 10
    slots: int = 5

    @property
    def folder(self) -> str:
        return f"{self.root}/{self.dataset}/{self.split}"


#: Boxes of the named regions: latitudes, longitudes.
REGIONS = {
    "southwestern": ((28.0, 35.0), (-120.0, -114.0)),
    "northeastern": ((41.0, 46.0), (-71.0, -65.0)),
    "southeastern": ((30.0, 36.0), (-81.0, -75.0)),
    "northwestern": ((42.0, 50.0), (-127.0, -122.0)),
}
#: What the functions default to.
FUNCTION_PRESET = CleanParams(lat=(30.0, 35.0), lon=(-120.0, -115.0), sog=(1.0, 22.0))


def job_preset(region: str = "southwestern") -> CleanParams:
    """What the batch job passes for a region."""
    lat, lon = REGIONS[region]
    return CleanParams(lat=lat, lon=lon, sog=(0.5, 40.0), min_entities=2, step_s=600)



#: offset and range of the inverse min-max scaling of positions.
LAT_SCALE = (20.90883, 28.32044)
LON_SCALE = (-133.29703, 72.60811)
SPLIT_DAYS = {"train": (1, 25), "val": (26, 28), "test": (29, 31)}
BUCKET_MS = 600_000
#: Windows that the persistence baseline takes.
BASELINE_WINDOWS = 1000
#: Ranges in which the statistics of scaled data are expected: mean and deviation.
EXPECTED_STATS = {"lon": ((-133.30, -133.29), (72.0, 73.0)), "lat": ((20.90, 20.91), (28.0, 29.0)), "sog": ((-0.1, 0.1), (29.0, 32.0)), "heading": ((-0.1, 0.1), (3.0, 3.2))}
#: Published displacement errors by horizon in minutes: average and final.
PUBLISHED = {10: (0.000609, 0.000807), 20: (0.000853, 0.001164), 30: (0.001157, 0.001771), 40: (0.001522, 0.002378), 50: (0.002436, 0.003946)}
