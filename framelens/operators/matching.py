"""Matching companion series and joining their window tables."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from framelens.operators.clean import fill_zero_duration
from framelens.operators.series import CHUNK_ROWS, Series, drop_stage, longest, ordinal, scan, stage

NO_NUMBER = 10**9
LOOK_AHEAD = 32
#: Sources and partners of a component that is settled in one task.
COMPONENT = 20_000


def natural_key(name: Column) -> Column:
    """Sort key: trailing number, then name."""
    digits = F.regexp_extract(name, r"(\d+)$", 1)
    return F.struct(F.when(digits != "", digits.cast("long")).otherwise(F.lit(NO_NUMBER)).alias("number"),
                    name.alias("name"))


def gaze_name_key(name: Column) -> Column:
    """Sort key of names such as ``gA_12_s3``: letter, number, session, panel flag, name."""
    pattern = r"^g([A-Z])_(\d+)_s(\d+)"
    letter = F.regexp_extract(name, pattern, 1)
    part = lambda i: F.regexp_extract(name, pattern, i)
    known = letter != ""
    num = lambda v: F.when(known, v).otherwise(F.lit(NO_NUMBER)).cast("long")
    return F.struct(num(F.ascii(letter)).alias("letter"), num(part(2).try_cast("long")).alias("number"),
                    num(part(3).try_cast("long")).alias("session"),
                    F.lower(name).contains("panel").cast("int").alias("panel"), name.alias("name"))


def series_profile(frames: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return frames.groupBy(*keys).agg(F.max("time_sec").alias("duration"), F.count(F.lit(1)).alias("rows"))


def match_candidates(sources: DataFrame, partners: DataFrame, tolerance: float, *,
                     group: tuple[str, ...] = ("label", "modality"), limit: int = CHUNK_ROWS) -> DataFrame:
    """Ranked partners within ``tolerance`` of each source *profile*.

    Sources of equal duration and row count have the same candidates in the same order, so the list is kept once
    per distinct ``(duration, rows)``: its size grows with the partners times the profiles inside the tolerance
    band, never with sources times partners. Columns: group, duration, rows, position, partner and score.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(tolerance))).cast("long")
    profiles = sources.select(*group, "duration", "rows").distinct().withColumn(
        "_b", F.explode(F.sequence(bucket("duration") - 1, bucket("duration") + 1)))
    offered = partners.select(*group, F.col("duration").alias("_pd"), F.col("rows").alias("_pr"), "partner",
                              bucket("duration").alias("_b"))
    near = F.abs(F.col("duration") - F.col("_pd")) <= F.lit(float(tolerance))
    pairs = profiles.join(offered, [*group, "_b"]).filter(near).select(
        *group, "duration", "rows", "partner",
        F.round(F.abs(F.col("duration") - F.col("_pd")), 6).alias("duration_diff"),
        F.abs(F.col("rows") - F.col("_pr")).alias("row_diff"))
    return ordinal(stage(pairs), [*group, "duration", "rows"],
                   ["duration_diff", "row_diff", gaze_name_key(F.col("partner"))], "position", limit)


def candidate_summary(sources: DataFrame, candidates: DataFrame, *,
                      group: tuple[str, ...] = ("label", "modality")) -> DataFrame:
    """Number of candidates and the best one, per source."""
    best = candidates.groupBy(*group, "duration", "rows").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.min_by("partner", "position").alias("best_partner"),
        F.min_by("duration_diff", "position").alias("best_duration_diff"),
        F.min_by("row_diff", "position").alias("best_row_diff"))
    return sources.join(best, [*group, "duration", "rows"], "left").withColumn(
        "candidates", F.coalesce("candidates", F.lit(0)))


def assign_in_rounds(sources: DataFrame, partners: DataFrame, tolerance: float, *,
                     group: tuple[str, ...] = ("label", "modality"), limit: int = CHUNK_ROWS) -> DataFrame:
    """``greedy_assign`` for components of any size.

    Solved in rounds over all groups at once instead of walking one group in order: every source proposes to a
    position of its profile's list, a partner keeps the proposer that comes first in the order, and the others
    move on to the next place that nobody before them holds. A source never lands before a better-placed source of its own profile, so positions inside a
    profile are kept strictly increasing, which lets many equal sources settle in the same round.
    """
    candidates = stage(match_candidates(sources, partners, tolerance, group=group, limit=limit))
    profile = [*group, "duration", "rows"]
    ranked = candidate_summary(sources, candidates, group=group)
    turn = F.struct("candidates", "best_duration_diff", "best_row_diff", gaze_name_key(F.col("best_partner")).alias("k"),
                    natural_key(F.col("source")).alias("n"))
    placed = ordinal(stage(ranked.withColumn("turn", turn)), profile, [natural_key(F.col("source"))], "_place", limit)
    state = stage(placed.withColumn("pos", F.col("_place")))
    top = longest(state, profile, limit)
    s = Series(tuple(profile), "_place", None if top <= limit else limit)
    places = candidates.select(*profile, F.col("position").alias("pos"), "partner")
    while True:
        offers = state.join(places, [*profile, "pos"], "left")
        holders = offers.filter("partner is not null").groupBy(*group, "partner").agg(F.min("turn").alias("_first"))
        judged = stage(offers.join(holders, [*group, "partner"], "left").withColumn(
            "_lost", F.col("partner").isNotNull() & (F.col("turn") != F.col("_first"))))
        drop_stage(state)
        lost = judged.filter("_lost")
        if lost.isEmpty():
            break
        taken = judged.filter("not _lost and partner is not null").select(*group, "partner", F.col("turn").alias("_holder"))
        ahead = lost.select(*profile, "source", "turn", F.explode(F.sequence(
            F.col("pos") + 1, F.col("pos") + LOOK_AHEAD)).alias("pos")).join(places, [*profile, "pos"], "left").join(
            taken, [*group, "partner"], "left")
        open_place = F.col("partner").isNull() | F.col("_holder").isNull() | (F.col("_holder") > F.col("turn"))
        next_place = ahead.groupBy(*group, "source").agg(F.coalesce(
            F.min(F.when(open_place, F.col("pos"))), F.max("pos") + 1).alias("_next"))
        moved = judged.join(next_place, [*group, "source"], "left").withColumn(
            "_p", F.coalesce("_next", "pos") - F.col("_place"))
        pushed = scan(moved, s, highest={"_least": F.col("_p")})
        before, state = judged, stage(pushed.withColumn("pos", F.col("_least") + F.col("_place")).select(*state.columns))
        drop_stage(before)
    status = (F.when(F.col("candidates") == 0, "no candidate").when(F.col("partner").isNull(), "all taken")
              .otherwise("matched"))
    return judged.select(*group, "source", "partner", "candidates", "best_partner", status.alias("status"))


def contention(sources: DataFrame, partners: DataFrame, tolerance: float, *, group: tuple[str, ...] = ("label", "modality"),
               limit: int = CHUNK_ROWS) -> DataFrame:
    """``group, duration, component, size``: durations of a group are cut where neighbours are more than the tolerance
    apart. No candidate pair spans such a gap, so components can be settled apart from each other. ``size`` counts the
    sources and partners of the component."""
    sides = sources.select(*group, "duration").unionByName(partners.select(*group, "duration"))
    points = stage(sides.groupBy(*group, "duration").agg(F.count(F.lit(1)).alias("n")))
    width = None if longest(points, group, limit) <= limit else max(float(tolerance), 1e-9)
    s = Series(tuple(group), "duration", width)
    gaps = scan(points, s, previous={"_before": F.col("duration")})
    cut = F.coalesce(F.col("duration") - F.col("_before") > F.lit(float(tolerance)), F.lit(False)).cast("int")
    numbered = scan(gaps.withColumn("_cut", cut), s, running={"component": F.col("_cut")})
    sizes = numbered.groupBy(*group, "component").agg(F.sum("n").alias("size"))
    return numbered.join(sizes, [*group, "component"]).select(*group, "duration", "component", "size")


def rounded(x: np.ndarray) -> np.ndarray:
    """To six decimals, halves up by the decimal value, as the column function does."""
    scaled = x * 1e6
    out = np.round(scaled) / 1e6
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-6"), ROUND_HALF_UP))
    return out


def settle_component(pdf: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    """One component: every source with its candidates counted, its best one, and the partner it gets.

    Partners lie in the order of their durations, so the candidates of a source are one slice. ``rank`` orders the names
    of each side.
    """
    mine, theirs = pdf[pdf["is_source"]], pdf[~pdf["is_source"]].sort_values(["duration", "rank"])
    d, rows, rank = theirs["duration"].to_numpy(np.float64), theirs["rows"].to_numpy(np.int64), theirs["rank"].to_numpy(np.int64)
    names, free = theirs["name"].to_numpy(object), np.ones(len(theirs), bool)
    own_d, own_rows = mine["duration"].to_numpy(np.float64), mine["rows"].to_numpy(np.int64)
    lo = np.searchsorted(d, own_d - tolerance - 1e-6)
    hi = np.searchsorted(d, own_d + tolerance + 1e-6, side="right")

    def candidates(i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(lo[i], hi[i])
        gap = np.abs(own_d[i] - d[at])
        at = at[gap <= tolerance]
        return at, rounded(gap[gap <= tolerance]), np.abs(own_rows[i] - rows[at])

    def first(at: np.ndarray, gap: np.ndarray, apart: np.ndarray) -> int:
        """Place of the best candidate among those given."""
        some = np.flatnonzero(gap == gap.min())
        some = some[apart[some] == apart[some].min()]
        return int(some[rank[at[some]].argmin()])

    n, best = np.zeros(len(mine), np.int64), np.full(len(mine), -1, np.int64)
    best_gap, best_apart = np.full(len(mine), np.nan), np.full(len(mine), -1, np.int64)
    for i in range(len(mine)):
        at, gap, apart = candidates(i)
        n[i] = len(at)
        if len(at):
            k = first(at, gap, apart)
            best[i], best_gap[i], best_apart[i] = at[k], gap[k], apart[k]
    got = np.full(len(mine), -1, np.int64)
    some = np.flatnonzero(n)
    for i in some[np.lexsort((mine["rank"].to_numpy(np.int64)[some], rank[best[some]], best_apart[some], best_gap[some], n[some]))].tolist():
        at, gap, apart = candidates(i)
        left = free[at]
        if left.any():
            got[i] = at[left][first(at[left], gap[left], apart[left])]
            free[got[i]] = False
    named = lambda at: [names[j] if j >= 0 else None for j in at.tolist()]
    plain = lambda values: pd.Series(values, dtype=object)  # noqa: E731  one piece with a type of its own, also if empty
    kept = {("source" if c == "name" else c): plain(mine[c].tolist()) for c in mine.columns
            if c not in ("is_source", "rank", "component", "size")}
    return pd.DataFrame({**kept, "partner": plain(named(got)), "candidates": n, "best_partner": plain(named(best)),
                         "best_duration_diff": pd.array(best_gap, "Float64"),
                         "best_row_diff": pd.array(np.where(best >= 0, best_apart, None), "Int64")})


def _settled(sources: DataFrame, partners: DataFrame, parts: DataFrame, tolerance: float, group: tuple[str, ...]) -> DataFrame:
    """Every source of the components of ``parts``, each component settled in a task."""
    sides = []
    for df, name, key, flag in ((sources, "source", natural_key, True), (partners, "partner", gaze_name_key, False)):
        place = Window.partitionBy(*group, "component").orderBy(key(F.col("name")))
        named = df.select(*group, F.col(name).alias("name"), "duration", F.col("rows").cast("long").alias("rows"))
        sides.append(named.join(parts, [*group, "duration"]).withColumns({"rank": F.row_number().over(place), "is_source": F.lit(flag)}))
    kinds = dict(sources.select(*group, "source", "duration").dtypes)
    schema = (", ".join(f"`{g}` {kinds[g]}" for g in group) + f", source string, duration {kinds['duration']}, rows long, partner string, "
              "candidates long, best_partner string, best_duration_diff double, best_row_diff long")
    order = [*group, "source", "duration", "rows", "partner", "candidates", "best_partner", "best_duration_diff", "best_row_diff"]
    both = sides[0].unionByName(sides[1])
    return both.groupBy(*group, "component").applyInPandas(lambda pdf: settle_component(pdf, tolerance)[order], schema)


def _with_parts(sources: DataFrame, partners: DataFrame, tolerance: float, group: tuple[str, ...], limit: int, most: int):
    """Sources without a place, components for one task each, and what lies in larger ones (None if nothing does)."""
    placed = F.col("duration").isNotNull() & ~F.isnan(F.col("duration").cast("double"))
    for g in group:
        placed = placed & F.col(g).isNotNull()
    parts = stage(contention(sources.filter(placed), partners.filter(placed), tolerance, group=group, limit=limit))
    large = parts.filter(F.col("size") > most)
    rest = None
    if not large.isEmpty():
        keys = [*group, "duration"]
        rest = [stage(df.join(large.select(*keys), keys, "left_semi")) for df in (sources, partners)]
    return sources.filter(~F.coalesce(placed, F.lit(False))), parts.filter(F.col("size") <= most), rest


def match_summary(sources: DataFrame, partners: DataFrame, tolerance: float, *, group: tuple[str, ...] = ("label", "modality"),
                  limit: int = CHUNK_ROWS, most: int = COMPONENT) -> DataFrame:
    """Number of candidates and the best one, per source, without a table of pairs.

    Only components of more than ``most`` rows go through ranked candidate lists.
    """
    nowhere, parts, rest = _with_parts(sources, partners, tolerance, group, limit, most)
    columns = [*group, "source", "duration", "rows", "candidates", "best_partner", "best_duration_diff", "best_row_diff"]
    out = _settled(sources, partners, parts, tolerance, group).select(*columns)
    if rest:
        listed = match_candidates(*rest, tolerance, group=group, limit=limit)
        out = out.unionByName(candidate_summary(rest[0], listed, group=group).select(*columns))
    return out.unionByName(nowhere.select(*columns[:-4], F.lit(0).cast("long").alias("candidates")), allowMissingColumns=True)


def greedy_assign(sources: DataFrame, partners: DataFrame, tolerance: float, *, group: tuple[str, ...] = ("label", "modality"),
                  limit: int = CHUNK_ROWS, most: int = COMPONENT) -> DataFrame:
    """Each source, by (fewest candidates, best score, name), takes its best partner that is still free.

    Groups fall into components that share no candidate. A component of at most ``most`` rows is walked in one task,
    larger ones are solved in rounds. Sources without a duration have no candidate.
    """
    nowhere, parts, rest = _with_parts(sources, partners, tolerance, group, limit, most)
    status = (F.when(F.col("candidates") == 0, "no candidate").when(F.col("partner").isNull(), "all taken").otherwise("matched"))
    columns = [*group, "source", "partner", "candidates", "best_partner", "status"]
    out = _settled(sources, partners, parts, tolerance, group).withColumn("status", status).select(*columns)
    if rest:
        out = out.unionByName(assign_in_rounds(*rest, tolerance, group=group, limit=limit).select(*columns))
    unplaced = nowhere.select(*group, "source", F.lit(None).cast("string").alias("partner"), F.lit(0).cast("long").alias("candidates"),
                              F.lit(None).cast("string").alias("best_partner"), F.lit("no candidate").alias("status"))
    return out.unionByName(unplaced)


def one_to_one_left_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], *, key: str = "window_id",
                         prefix: str = "gaze_") -> tuple[DataFrame, DataFrame]:
    """Left join on the series keys and ``key``; series with a repeated key on either side become error rows."""
    on = [*keys, key]
    repeated = lambda df, side: (df.groupBy(*on).count().filter("count > 1").groupBy(*keys)
                                 .agg(F.count(F.lit(1)).alias("repeated_keys")).withColumn("side", F.lit(side)))
    errors = repeated(left, "left").unionByName(repeated(right, "right"))
    named = right.select(*[F.col(c) if c in on else F.col(c).alias(prefix + c) for c in right.columns])
    named = named.withColumn("_found", F.lit(True))
    good = left.join(errors.select(*keys).distinct(), list(keys), "left_anti")
    merged = good.join(named, on, "left").withColumn("matched", F.coalesce("_found", F.lit(False))).drop("_found")
    return fill_zero_duration(merged, prefix), errors


def merge_report(left: DataFrame, right: DataFrame, merged: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    rows = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    hits = merged.groupBy(*keys).agg(F.sum(F.col("matched").cast("long")).alias("matched_rows"))
    joined = rows(left, "baseline_rows").join(rows(right, "gaze_rows"), list(keys), "left").join(
        hits, list(keys), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        *keys, "baseline_rows", zero("gaze_rows").alias("gaze_rows"), zero("matched_rows").alias("matched_rows"),
        (F.col("baseline_rows") - zero("matched_rows")).alias("missing_rows"),
        F.when(F.col("baseline_rows") == zero("matched_rows"), "ok").otherwise("partial").alias("status"))


def resolve_partner(streams: DataFrame, mapping: DataFrame, primary: DataFrame, fallback: DataFrame, *,
                    group: tuple[str, ...] = ("label", "modality")) -> tuple[DataFrame, DataFrame]:
    """Stream → matched partner → its window table in the primary or else the fallback location."""
    mapped = streams.join(mapping.filter("status = 'matched'").select(*group, "source", "partner"),
                          [*group, "source"], "left")
    place = lambda df, name: df.select(*group, "partner", F.col("location").alias(name))
    found = mapped.join(place(primary, "_a"), [*group, "partner"], "left").join(
        place(fallback, "_b"), [*group, "partner"], "left").withColumn("location", F.coalesce("_a", "_b")).drop("_a", "_b")
    error = F.when(F.col("partner").isNull(), "no matched partner").otherwise("partner windows not found")
    return (found.filter("location is not null"),
            found.filter("location is null").select(*group, "source", error.alias("error")))
