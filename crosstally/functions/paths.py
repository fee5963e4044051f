"""What a file path says: name, extension, levels and tagged parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The part names that carry a tag of their own.
STAGES = ("input", "output", "intermediate")
SCENARIOS = ("baseline", "adverse", "severely_adverse")
PLAIN_PARTS = ("dev", "ccar", "output", "input")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_extension(path: Column) -> Column:
    """Lower-cased extension without the dot; '' when there is none (a leading dot is no extension)."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def separator_for(path: str) -> str:
    """Field separator implied by a file suffix."""
    lowered = path.lower()
    if lowered.endswith((".psv", ".pipe")):
        return "|"
    return "\t" if lowered.endswith(".tsv") else ","


def _last(parts: Column, pred) -> Column:
    return F.try_element_at(F.filter(parts, pred), F.lit(-1))


def path_components(path: Column, skip: int = 0) -> dict[str, Column]:
    """Folder levels 1..4 below the first ``skip`` parts, and version, run, stage, scenario and cycle tags.

    Of several parts with the same tag the last one counts.
    """
    all_parts = F.split(path, "/")
    parts = F.slice(all_parts, skip + 1, F.greatest(F.size(all_parts) - 1 - skip, F.lit(0)))
    levels = {f"level_{n}": F.try_element_at(parts, F.lit(n)) for n in range(1, 5)}
    return levels | {
        "version": _last(parts, lambda p: p.rlike("^v[0-9]+$")),
        "run_id": _last(parts, lambda p: p.rlike("^run[0-9]+$")),
        "stage": _last(parts, lambda p: p.isin(*STAGES)),
        "scenario": _last(parts, lambda p: p.isin(*SCENARIOS)),
        "cycle": _last(parts, lambda p: p.rlike("^cycle[0-9]+$")),
    }


def path_components_by_prefix(path: Column) -> dict[str, Column]:
    """Looser tagging for report trees: any part with 'cycle', scenario by its prefix, run by its prefix,
    and the first other inner part as the process. A part takes the first rule that fits it."""
    parts = F.split(path, "/")
    n = F.size(parts)
    cyc = lambda p: p.contains("cycle")
    scn = lambda p: ~cyc(p) & p.rlike("^(internal_|supervisory_)")
    run = lambda p: ~cyc(p) & p.startswith("run")
    inner = F.slice(parts, 2, F.greatest(n - 3, F.lit(0)))
    other = lambda p: ~cyc(p) & ~p.rlike("^(internal_|supervisory_|run)") & ~p.isin(*PLAIN_PARTS) & (p != "")
    return {
        "cycle": _last(parts, cyc),
        "scenario": _last(parts, scn),
        "run_id": _last(parts, run),
        "process": F.try_element_at(F.filter(inner, other), F.lit(1)),
    }


def path_components_by_position(path: Column, cycle: int = 4, scenario: int = 6, run: int = 7) -> dict[str, Column]:
    """Tags at fixed (0-based) positions of the path, and the table name from the file name."""
    parts = F.split(path, "/")
    at = lambda i: F.get(parts, F.lit(i))
    return {
        "cycle": at(cycle),
        "scenario": at(scenario),
        "run_id": at(run),
        "table_name": F.regexp_replace(file_name(path), r"\.csv", ""),
    }
