"""The whole review as one plan: diffs to ranked hunks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.functions.signals import none, weighted
from hunkwise.operators import context_rules as ctx
from hunkwise.operators.parse import parse_hunks, parse_rows
from hunkwise.operators.profiles import checked, with_profiles
from hunkwise.operators.rules import base_pack, with_text
from hunkwise.operators.score import ranked, scored
from hunkwise.plans.config import checked_surfaces, checked_weights
from hunkwise.sources.worktables import WorkTables


@dataclass(frozen=True)
class Options:
    """What a review looks at; every table beside the diffs is optional."""

    pack: str = "cli"
    weights: dict[str, float] = field(default_factory=dict)
    extra_surface: Sequence[tuple[str, int, str]] = ()
    tree: DataFrame | None = None  # path, text of the repository's files: blast radius
    file_stats: DataFrame | None = None  # hotspots
    codeowners: Sequence[tuple[str, list[str]]] = ()
    author: str = ""
    intent: Column | None = None
    no_tests: bool = False
    profiles: Sequence[str] = ()
    custom_profiles: dict[str, dict[str, float]] = field(default_factory=dict)
    bodies: bool = True  # keep the hunks' headings and texts, which documents show

    def __post_init__(self):
        checked_weights(self.weights)
        checked_surfaces(self.extra_surface)
        checked(self.custom_profiles)


def _adding(hunks: DataFrame, rule, weight: float) -> DataFrame:
    """``rule`` appends to signals; what it appends is weighted."""
    if weight == 1.0:
        return rule(hunks)
    out = rule(hunks.withColumn("_had", F.size("signals")))
    fresh = F.slice("signals", F.col("_had") + 1, F.greatest(F.lit(0), F.size("signals") - F.col("_had")))
    kept = F.filter(weighted(fresh, weight), lambda s: s["points"] > 0)
    return out.withColumn("signals", F.concat(F.slice("signals", 1, F.col("_had")), kept)).drop("_had")


def review(diffs: DataFrame, options: Options = Options(), tables: WorkTables | None = None) -> DataFrame:
    """Ranked hunks of diffs (diff_id, text), with signals, raw, score, tier and rank.

    The diffs are parsed once. Rules that look at a whole diff read its files and hunks out of that parse.
    For the blast radius, whose symbols are read before and after the tree, the parsed rows are written first; they
    stay until the session or the scope ends.
    """
    o, weight = options, lambda name: options.weights.get(name, 1.0)
    rows = with_text((parse_rows if o.no_tests else parse_hunks)(diffs))
    rows = rows.withColumn("signals", base_pack(o.pack, o.weights, o.extra_surface)).drop("_added", "_removed")
    later = none()
    if o.intent is not None:
        before = rows.withColumn("_before", F.col("signals")).withColumn("signals", none())
        stated = _adding(before, lambda h: ctx.with_intent(h, o.intent), weight("intent"))
        rows, later = stated.withColumn("_intent", F.col("signals")).withColumn("signals", F.col("_before")).drop("_before"), F.col("_intent")
    dropped = [] if o.bodies else ["heading", "body"]
    if o.tree is not None:
        tables = tables or WorkTables(diffs.sparkSession)
        rows = tables.put(rows.withColumn("_symbols", ctx.symbols()).drop(*dropped))
        own = ctx.hunk_symbols(rows.where("hunk_seq > 0"), F.col("_symbols"))
        rows = _adding(rows, lambda h: ctx.with_blast_radius(h, own, o.tree, tables), weight("blast-radius")).drop("_symbols")
    else:
        rows = rows.drop(*dropped)
    if o.file_stats is not None:
        rows = _adding(rows, lambda h: ctx.with_hotspots(h, o.file_stats), weight("hotspots"))
    if o.codeowners and o.author:
        rows = _adding(rows, lambda h: ctx.with_owners(h, o.codeowners, o.author), weight("owners"))
    rows = rows.withColumn("signals", F.concat("signals", later)).drop("_intent")
    if o.no_tests:
        rows = ctx.with_test_evidence(rows).where("hunk_seq > 0")
        rows = _adding(rows, ctx.with_no_tests, weight("no-tests"))
    out = ranked(scored(rows))
    return with_profiles(out, list(o.profiles), o.custom_profiles) if o.profiles else out
