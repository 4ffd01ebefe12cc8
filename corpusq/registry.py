"""Every query of the engine by name, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .plans import audited, compiled, evaluated, pages, ranked, searched, stored, streamed, structured, tagged, verified
from .sources.store import importable

PLANS = [pages.plan, searched.plan, ranked.plan, tagged.plan, verified.plan, compiled.plan, evaluated.plan, stored.plan, structured.plan, streamed.plan, audited.plan]

#: Columns that are registered as JSON text, so that a result is a flat table: arrays.
ARRAYS = {
    "anchor_coverage": ["missing"],
    "cards_prepared": ["images", "tags"],
    "checklists": ["checklist"],
    "claims": ["markers"],
    "claims_compiled": ["cites"],
    "coverage_drops": ["missing"],
    "coverage_gaps": ["gaps"],
    "decision_cards": ["bottom_line", "furniture", "uncertainties"],
    "groundedness": ["unsupported_markers", "bleed_terms"],
    "levels_named": ["levels"],
    "lines_parsed": ["refs"],
    "missed_by_arms": ["arms"],
    "other_features": ["others"],
    "preferences": ["sources"],
    "records_coerced": ["history"],
    "references_assembled": ["sections"],
    "reviewed_claims": ["flags"],
    "tags": ["tags"],
    "topics": ["missing"],
    "verified_claims": ["bleed_terms"],
}
#: Columns whose type DuckDB would choose wider.
LONGS = {"all_terms": ["score"], "book_fingerprint": ["books"], "chunk_shape": ["total_words"], "fingerprint": ["rows"], "text_fingerprint": ["rows"], "groundedness_summary": ["cited", "unsupported"], "judging_budget": ["spent"], "judging_cost": ["tokens_in"], "reference_share": ["removed", "kept"]}
DOUBLES = {"coverage_drops": ["before"], "defect_ledger": ["confidence"]}


def _flat(name: str, f):
    def run(spark, sf_dir):
        importable(spark)
        out = f(spark, sf_dir)
        changed = {c: F.to_json(F.col(c)) for c in ARRAYS.get(name, [])} | {c: F.col(c).cast("long") for c in LONGS.get(name, [])} | {c: F.col(c).cast("double") for c in DOUBLES.get(name, [])}
        return out.withColumns(changed) if changed else out

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def queries() -> dict:
    return {k: _flat(k, f) for p in PLANS for k, f in p.queries.items()}


def oracle_sql() -> dict:
    out = {}
    for k, sql in ((k, s) for p in PLANS for k, s in p.sql.items()):
        changed = [f"CAST(to_json({c}) AS VARCHAR) AS {c}" for c in ARRAYS.get(k, [])] + [f"CAST({c} AS BIGINT) AS {c}" for c in LONGS.get(k, [])] + [f"CAST({c} AS DOUBLE) AS {c}" for c in DOUBLES.get(k, [])]
        out[k] = f"SELECT * REPLACE ({', '.join(changed)}) FROM ({sql})" if changed else sql
    return out
