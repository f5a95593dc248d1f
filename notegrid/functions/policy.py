"""Which memories may surface, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIVATE = ("feel", "plan", "letter", "self", "i")


def denial_reasons(mode: str, cols: dict[str, Column] | None = None) -> Column:
    """Reasons against surfacing a row in a mode (spontaneous, dream, importance, search), in fixed order."""
    c = lambda n: (cols or {}).get(n, F.col(n))
    core = c("pinned") | (c("type") == "permanent") | c("anchor")
    rules = [(c("type") == "tombstone", "tombstone"), (c("type") == "archived", "archived")]
    if mode in ("spontaneous", "dream", "importance"):
        rules += [(F.trim(F.coalesce(c("superseded_by"), F.lit(""))) != "", "superseded"), (c("dont_surface"), "dont_surface")]
        if mode != "importance":
            rules += [(c("digested") & ~core, "digested"), (c("anchor"), "anchor")]
        rules += [(c("type").isin(*PRIVATE), "private_type")]
    return F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in rules]), lambda x: x.isNotNull())


def allowed(mode: str) -> Column:
    return F.size(denial_reasons(mode)) == 0


def terminal() -> Column:
    return F.col("type").isin("archived", "tombstone")


def audit_candidate(least: int) -> Column:
    """The scope of the importance audit."""
    return (F.col("importance") >= least) & ~F.col("dont_surface") & (F.trim(F.coalesce("superseded_by", F.lit(""))) == "") & ~terminal() & ~F.col("type").isin("feel", "plan", "letter", "archived")


REASONS_SQL = {
    m: "array_to_string(list_filter([" + ", ".join(["CASE WHEN type = 'tombstone' THEN 'tombstone' END", "CASE WHEN type = 'archived' THEN 'archived' END", *({"search": []}.get(m, ["CASE WHEN superseded_by IS NOT NULL THEN 'superseded' END", "CASE WHEN dont_surface THEN 'dont_surface' END", *([] if m == "importance" else ["CASE WHEN digested AND NOT (pinned OR type = 'permanent' OR anchor) THEN 'digested' END", "CASE WHEN anchor THEN 'anchor' END"]), "CASE WHEN type IN ('feel', 'plan', 'letter', 'self', 'i') THEN 'private_type' END"]))]) + "], lambda x: x IS NOT NULL), ',')"
    for m in ("spontaneous", "dream", "importance", "search")
}
ALLOWED_SQL = {m: f"({x} = '')" for m, x in REASONS_SQL.items()}
AUDIT_SQL = "(importance >= {} AND NOT dont_surface AND superseded_by IS NULL AND type NOT IN ('archived', 'tombstone', 'feel', 'plan', 'letter'))"
