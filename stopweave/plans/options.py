"""Rules and numbers of a mode of transport."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from stopweave.operators.rules import Rule

Rules = Sequence[Rule]
Attributes = Sequence[tuple[str, Rule | None]]
Chain = Sequence[tuple[str, str]]
#: Metres a second of a kilometre an hour (fixed value of the rule files).
KMH = 0.2777


@dataclass(frozen=True)
class Options:
    """Defaults are those for roads; a rule file sets them for each mode."""

    keep: Rules = (Rule("highway"),)
    drop: Rules = ()
    levels: Sequence[Rules] = ()
    oneway: Rules = (Rule("oneway", "yes"),)
    reverse: Rules = (Rule("oneway", "-1"),)
    twoway: Rules = ()
    stations: Rules = ()
    blockers: Rules = ()
    turning_circles: Rules = ()
    no_hup: Rules = ()
    restrict_only: Rules = ()
    restrict_no: Rules = ()
    restrict_exempt: Rules = ()

    station_names: Attributes = ()
    station_ids: Attributes = ()
    tracks: Attributes = ()
    edge_tracks: Attributes = ()
    line_name: Attributes = ()
    line_from: Attributes = ()
    line_to: Attributes = ()
    line_color: Attributes = ()

    station_chain: Chain = ()
    line_chain: Chain = ()
    track_chain: Chain = ()
    id_chain: Chain = ()

    #: Metres a second of each level.
    speeds: Sequence[float] = tuple(v * KMH for v in (85, 70, 55, 40, 30, 20, 10, 5))
    snap_m: float = 100.0
    #: Reach of stations as candidates; None: twice as far as edges.
    station_m: float | None = None
    osm_station_m: Sequence[float] = (15.0,)
    #: None: an eighth of the largest distance of an OSM station.
    block_m: float | None = None
    max_snap_level: int = 7
    wrong_way_factor: float = 5.0
    wrong_way_entry_s: float = 300.0
    no_lines_factor: float = 1.0
    full_turn_s: float = 0.0
    full_turn_angle: float = 5.0
    snap_turn_angle: float | None = None

    emission_method: str = "exp"
    emission: float = 0.0039
    transition_method: str = "exp"
    transition: float = 0.0083
    #: Factors of edges whose lines do not resemble the trip's: name, from, to.
    factors: tuple[float, float, float] = (1.2, 1.05, 1.1)
    use_stations: bool = True
    non_station_pen: float = 0.0
    #: None: half of ``non_station_pen``.
    station_unmatched_pen: float | None = None
    platform_pen: float = 0.0
    #: ``mismatch``, or ``match`` as some rule files were tuned for.
    platform_pen_on: str = "mismatch"
    similarity: str = "jaccard-geodist"
    drop_shapes: bool = True
    #: Standard deviation, in metres, of noise on the places of stops.
    noise_m: float = 0.0
    seed: int = 0
    max_lat: float = 72.0

    @property
    def station_reach(self) -> float:
        return 2 * self.snap_m if self.station_m is None else self.station_m

    @property
    def station_pen(self) -> float:
        return self.non_station_pen / 2 if self.station_unmatched_pen is None else self.station_unmatched_pen

    @property
    def restricted(self) -> int:
        """Cost, in tenths of a second, of a turn that is forbidden: a hundred times the entry in seconds."""
        return min(int(self.wrong_way_entry_s * 100), 4_294_967_295)

    @property
    def top_speed(self) -> float:
        """What no path is faster than: factors below 1 make edges cheaper."""
        shrink = 1.0
        for f in (*self.factors, self.no_lines_factor, self.wrong_way_factor):
            shrink *= min(f, 1.0)
        return max(self.speeds) / max(shrink, 1e-6)
