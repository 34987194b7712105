"""Model comparison over shared splits and the scenario grid."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from framelens.config import SCENARIOS
from framelens.operators.clean import align_union
from framelens.operators.metrics import master_summary, metrics_row, rank_models
from framelens.operators import models as fitting
from framelens.operators.models import REGISTRY, Fit, prepare, resolve_models, train_model
from framelens.operators.rules import feature_columns, high_confidence_filter, training_filter
from framelens.operators.series import stage
from framelens.operators.split import group_split, with_group_id


def training_rows(windows: DataFrame, feature_set: str, high_confidence: bool) -> DataFrame:
    rows = training_filter(with_group_id(windows), feature_set)
    return high_confidence_filter(rows) if high_confidence else rows


#: Models fitted at a time: a fit of a small table leaves most of a cluster idle.
PARALLEL = 8


def _at_once(jobs: list[Callable]) -> list:
    with ThreadPool(min(PARALLEL, max(1, len(jobs)))) as pool:
        return pool.map(lambda job: inheritable_thread_target(job)(), jobs)


def _many(jobs: list[tuple], options: dict | None) -> list[tuple[Fit, DataFrame]]:
    """Fit and judge ``(model, train, test, feature set, high confidence)``: boosted models are grown together, the
    others are fitted side by side."""
    together = [j for j in jobs if REGISTRY[j[0]].build is fitting.boost_one]
    sides = _at_once([lambda j=j: prepare(j[1], feature_columns(j[3]), REGISTRY[j[0]].weighted) for j in together])
    settings = [{**REGISTRY[j[0]].options, **(options or {}).get(j[0], {})} for j in together]
    fits: dict[int, Fit] = {}

    def boost() -> None:
        fits.update(zip(map(id, together), fitting.boosted(list(zip(sides, settings)))))

    def judge(j: tuple) -> tuple[Fit, DataFrame]:
        key, train, test, feature_set, high_confidence = j
        fit = fits[id(j)] if id(j) in fits else train_model(key, train, feature_columns(feature_set), (options or {}).get(key))
        return fit, stage(metrics_row(fit.predict(test), train, model_key=key, model_label=REGISTRY[key].label,
                                      feature_set=feature_set, use_high_confidence=high_confidence))

    alone = [j for j in jobs if j not in together]
    first = _at_once([*([boost] if together else []), *[lambda j=j: judge(j) for j in alone]])
    done = dict(zip(map(id, alone), first[1 if together else 0:]))
    done.update(zip(map(id, together), _at_once([lambda j=j: judge(j) for j in together])))
    return [done[id(j)] for j in jobs]


def _sides(windows: DataFrame, feature_set: str, high_confidence: bool, seed: int) -> tuple[DataFrame, DataFrame]:
    train, test = group_split(stage(training_rows(windows, feature_set, high_confidence)), seed)
    return stage(train), stage(test)


def compare_models(windows: DataFrame, feature_set: str = "baseline", high_confidence: bool = False,
                   models: str | list[str] = "all", options: dict[str, dict] | None = None, seed: int = 42,
                   ) -> tuple[DataFrame, dict[str, Fit]]:
    """Every model on the same split, best first."""
    wanted = resolve_models(models)
    train, test = _sides(windows, feature_set, high_confidence, seed)
    done = _many([(k, train, test, feature_set, high_confidence) for k in wanted], options)
    return rank_models(stage(align_union([row for _, row in done]))), {k: fit for k, (fit, _) in zip(wanted, done)}


def scenario_grid(tables: dict[str, DataFrame], scenarios: list[str] | None = None, models: str | list[str] = "all",
                  options: dict[str, dict] | None = None, seed: int = 42) -> DataFrame:
    """Models by scenarios; ``tables`` maps a feature set to its window table, and an absent one is skipped."""
    known = [name for name, _, _ in SCENARIOS]
    unknown = set(scenarios or []) - set(known)
    if unknown:
        raise ValueError(f"unknown scenario: {', '.join(sorted(unknown))}")
    wanted, chosen = resolve_models(models), [s for s in SCENARIOS if not scenarios or s[0] in scenarios]
    results, there = [name for name, _, _ in chosen], [s for s in chosen if s[1] in tables]
    # A split is a dozen small jobs after one another, so those of all scenarios go side by side.
    sides = _at_once([lambda f=f, high=high: _sides(tables[f], f, high, seed) for _, f, high in there]) if there else []
    jobs = [(name, (k, *side, f, high)) for (name, f, high), side in zip(there, sides) for k in wanted]
    rows: dict[str, list[DataFrame]] = {}
    for (name, _), (_, row) in zip(jobs, _many([job for _, job in jobs], options)):
        rows.setdefault(name, []).append(row)
    return master_summary({name: rank_models(stage(align_union(rows[name]))) if name in rows else None for name in results})
