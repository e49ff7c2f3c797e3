"""Rule files: sections of comma-joined modes, ``key: value`` lines, values over several lines, ``#`` comments.

Later files, and later sections, override what earlier ones say about the same mode and key.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from stopweave.operators.rules import FLAT, MULTI, SKIP_NODE, SKIP_RELATION, SKIP_WAY, Rule
from stopweave.plans.options import KMH, Options

#: Names of the flags that may follow a rule's value (fixed values of the format).
FLAGS = {"rel_flat": FLAT, "mult_val_match": MULTI, "no_match_nds": SKIP_NODE, "no_match_rels": SKIP_RELATION, "no_match_ways": SKIP_WAY}


def parse(*texts: str) -> dict[str, dict[str, list[str]]]:
    """Values of every key by mode, as lists. A key begins its line; what is indented belongs to the key above."""
    out: dict[str, dict[str, list[str]]] = {}
    for text in texts:
        modes: list[str] = []
        key = None
        for line in text.splitlines():
            line = _without_comment(line).rstrip()
            if not line.strip():
                continue
            if m := re.fullmatch(r"\s*\[([^\]=]*)\]\s*", line):
                modes, key = [x.strip() for x in m[1].split(",") if x.strip()], None
                for name in modes:
                    out.setdefault(name, {})
                continue
            if m := re.match(r"([A-Za-z0-9_]+)\s*:(?!/)(.*)", line):
                key, rest = m[1], m[2]
                for name in modes:
                    out[name][key] = []
            else:
                rest = line
            if key is None or not modes:
                raise ValueError(f"outside any section: {line.strip()!r}")
            for name in modes:
                out[name][key] += [v.strip() for v in _split(rest) if v.strip()]
    return out


def _outside_quotes(line: str) -> list[int]:
    """Places that no quotes enclose. A quote opens at the line's start or after a space."""
    out, quote = [], ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and line[i + 1 : i + 2] in ("", " ", "\t", ";") else quote
        elif c in "'\"" and (not i or line[i - 1] in " \t"):
            quote = c
        else:
            out.append(i)
    return out


def _without_comment(line: str) -> str:
    ends = [i for i in _outside_quotes(line) if line[i] == "#" and (not i or line[i - 1].isspace())]
    return line[: ends[0]] if ends else line


def _split(line: str) -> list[str]:
    cuts = [i for i in _outside_quotes(line) if line[i] == ";"]
    return [line[a:b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(line)], strict=True)]


def rules(values: Iterable[str]) -> tuple[Rule, ...]:
    """``key=value|flag,...`` entries, also several on a line."""
    out = []
    for entry in " ".join(values).split():
        for one in entry.split(","):
            body, *flags = one.split("|")
            if body:
                key, _, value = body.partition("=")
                out.append(Rule(key, value or "*", sum({FLAGS[f] for f in flags})))
    return tuple(out)


def attributes(values: Iterable[str]) -> list[tuple[str, Rule | None]]:
    """Attribute names, with a rule in brackets for those that are read from a containing relation."""
    out: list[tuple[str, Rule | None]] = []
    for entry in " ".join(values).split():
        m = re.fullmatch(r"\[([^\]]*)\](.*)", entry)
        out.append((m[2], rules([m[1]])[0]) if m else (entry, None))
    return out


def replacements(values: Iterable[str]) -> list[tuple[str, str]]:
    """``pattern -> replacement`` pairs; either side may be quoted."""
    out = []
    for v in values:
        left, arrow, right = v.partition("->")
        if not arrow:
            raise ValueError(f"no replacement in {v!r}")
        unquote = lambda s: s[1:-1] if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"" else s
        out.append((unquote(left.strip()), unquote(right.strip())))
    return out


#: Keys of the rule files and the options they set: as rules, attributes, chains, or numbers (fixed names of the format).
RULES = {
    "osm_filter_keep": "keep", "osm_filter_drop": "drop", "osm_filter_oneway": "oneway", "osm_filter_oneway_reverse": "reverse",
    "osm_filter_undirected": "twoway", "osm_filter_station": "stations", "osm_filter_station_blocker": "blockers",
    "osm_filter_turning_circle": "turning_circles", "osm_filter_nohup": "no_hup", "osm_node_positive_restriction": "restrict_only",
    "osm_node_negative_restriction": "restrict_no", "osm_filter_no_restriction": "restrict_exempt",
}
ATTRIBUTES = {
    "osm_station_name_attrs": "station_names", "osm_station_id_attrs": "station_ids", "osm_track_number_tags": "tracks",
    "osm_edge_track_number_tags": "edge_tracks",
}
CHAINS = {
    "station_normalize_chain": "station_chain", "line_normalize_chain": "line_chain", "track_normalize_chain": "track_chain",
    "station_id_normalize_chain": "id_chain",
}
NUMBERS = {
    "osm_max_snap_distance": "snap_m", "osm_max_station_cand_distance": "station_m", "osm_max_node_block_distance": "block_m",
    "osm_one_way_speed_penalty_fac": "wrong_way_factor", "osm_one_way_entry_cost": "wrong_way_entry_s",
    "routing_full_turn_penalty": "full_turn_s", "routing_full_turn_angle": "full_turn_angle",
    "routing_snap_full_turn_angle": "snap_turn_angle", "routing_no_lines_penalty_fac": "no_lines_factor",
    "routing_transition_penalty_fac": "transition", "routing_station_move_penalty_fac": "emission",
    "routing_non_station_penalty": "non_station_pen", "routing_station_unmatched_penalty": "station_unmatched_pen",
    "routing_platform_unmatched_penalty": "platform_pen",
}
#: Keys of older files: the key that took their place, and what their number becomes there.
OLDER = {
    "routing_one_way_meter_punish_fac": ("osm_one_way_speed_penalty_fac", lambda v: 1 + v),
    "routing_no_lines_punish_fac": ("routing_no_lines_penalty_fac", lambda v: 1 + v),
    "routing_line_unmatched_punish_fac": ("routing_line_unmatched_time_penalty_fac", lambda v: 1 + v),
    "osm_max_snap_fallback_distance": ("osm_max_station_cand_distance", lambda v: v),
    "routing_platform_unmatched_punish": ("routing_platform_unmatched_penalty", lambda v: v),
    "routing_non_osm_station_punish": ("routing_non_station_penalty", lambda v: v),
    "routing_station_distance_punish_fac": ("routing_station_move_penalty_fac", lambda v: v),
}
FACTORS = (
    "routing_line_unmatched_time_penalty_fac",
    "routing_line_station_from_unmatched_time_penalty",
    "routing_line_station_to_unmatched_time_penalty",
)
METHODS = {
    "routing_emission_method": ("emission_method", {"exp", "norm"}),
    "routing_transition_method": ("transition_method", {"exp", "distdiff", "timenorm"}),
    "station_similarity_classification_method": ("similarity", {"jaccard", "jaccard-geodist", "bts", "ed", "ped"}),
}
LINE_TAGS = {"line_name": "line_name", "from_name": "line_from", "to_name": "line_to", "line_color": "line_color"}


def options(values: Mapping[str, list[str]]) -> Options:
    """The options of a mode; a key that is unknown is an error, so that a misspelt one does not pass unseen."""
    values = dict(values)

    def number(key: str) -> float:
        (text,) = " ".join(values[key]).replace(",", " ").split()
        if (v := float(text)) < 0:
            raise ValueError(f"{key}: {text} is negative")
        return v

    for old, (new, to) in OLDER.items():
        if old in values:
            values.setdefault(new, [repr(to(number(old)))])
            del values[old]
    out: dict[str, object] = {"oneway": (), "reverse": (), "wrong_way_factor": 1.0, "wrong_way_entry_s": 0.0, "factors": (1.0, 1.0, 1.0), "snap_m": 50.0}
    out["keep"] = ()
    out |= {name: rules(values[key]) for key, name in RULES.items() if key in values}
    out |= {name: tuple(attributes(values[key])) for key, name in ATTRIBUTES.items() if key in values}
    out |= {name: tuple(replacements(values[key])) for key, name in CHAINS.items() if key in values}
    out |= {name: number(key) for key, name in NUMBERS.items() if key in values}
    out["levels"] = tuple(rules(values.get(f"osm_filter_lvl{i}", ())) for i in range(8))
    kmh = [number(k) if (k := f"osm_lvl{i}_avg_speed") in values else 85 / number(f) if (f := f"routing_lvl{i}_fac") in values else v
           for i, v in enumerate((85, 70, 55, 40, 30, 20, 10, 5))]
    out["speeds"] = tuple(v * KMH for v in kmh)
    if "routing_full_turn_punish" in values:
        out.setdefault("full_turn_s", number("routing_full_turn_punish") / out["speeds"][0])
    out["factors"] = tuple(number(k) if k in values else 1.0 for k in FACTORS)
    if "osm_max_snap_level" in values:
        out["max_snap_level"] = int(number("osm_max_snap_level"))
    if "osm_max_osm_station_distance" in values:
        out["osm_station_m"] = tuple(float(v) for v in " ".join(values["osm_max_osm_station_distance"]).replace(",", " ").split())
    if "routing_use_stations" in values:
        out["use_stations"] = values["routing_use_stations"][0].lower() in ("1", "true", "yes")
    for key, (name, known) in METHODS.items():
        if key in values:
            (method,) = values[key]
            if method not in known:
                raise ValueError(f"{key}: {method} is none of {', '.join(sorted(known))}")
            out[name] = method
    for entry in " ".join(values.get("osm_line_relation_tags", ())).split():
        kind, _, tags = entry.partition("=")
        out[LINE_TAGS[kind]] = tuple((t, None) for t in tags.split(",") if t)
    known = {*RULES, *ATTRIBUTES, *CHAINS, *NUMBERS, *FACTORS, *METHODS, "osm_max_snap_level", "osm_max_osm_station_distance", "routing_use_stations"}
    known |= {"osm_line_relation_tags", "routing_full_turn_punish", "routing_no_self_hops", "routing_pass_thru_station_punish", "osm_station_group_attrs"}
    if unknown := [k for k in values if k not in known and not re.fullmatch(r"osm_filter_lvl[0-7]|osm_lvl[0-7]_avg_speed|routing_lvl[0-7]_fac", k)]:
        raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
    return Options(**out)


@dataclass(frozen=True)
class Mode:
    """Options, and the modes that share them."""

    modes: tuple[str, ...]
    options: Options


def modes(parsed: Mapping[str, Mapping[str, list[str]]]) -> list[Mode]:
    """One entry for all modes whose options are equal, in all of them, as one run serves them."""
    found: dict[Options, list[str]] = {}
    for name, values in parsed.items():
        found.setdefault(options(values), []).append(name)
    return [Mode(tuple(names), own) for own, names in found.items()]


def search_path(prefix: str, home: str, cwd: str, name: str = "stopweave.cfg") -> list[str]:
    """Where rule files are looked for, the later ones stronger."""
    return [f"{prefix}/etc/stopweave/{name}", f"{home}/.config/stopweave/{name}", f"{cwd}/{name}"]
