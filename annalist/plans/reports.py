"""Markdown of reports that are small by construction: tiers by systems, categories, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shown(value) -> str:
    """Numbers with three decimals, large ones with one; null as N/A."""
    if value is None:
        return "N/A"
    if isinstance(value, float):
        return f"{value:.1f}" if abs(value) >= 100 else f"{value:.3f}"
    return str(value).replace("|", "\\|")


def markdown(rows: DataFrame) -> str:
    """A table of all rows, fetched a partition at a time."""
    lines = [f"| {' | '.join(rows.columns)} |", f"|{'---|' * len(rows.columns)}"]
    return "\n".join(lines + [f"| {' | '.join(map(shown, r))} |" for r in rows.toLocalIterator()])


def leaderboard(rows: DataFrame, tier: str = "tier") -> str:
    """A table for each tier, by rank."""
    parts = []
    for (name,) in rows.select(tier).distinct().orderBy(tier).collect():
        parts.append(f"## {shown(name)}\n\n{markdown(rows.where(F.col(tier).eqNullSafe(F.lit(name))).drop(tier).orderBy('rank'))}")
    return "\n\n".join(parts)


def full_leaderboard(rows: DataFrame) -> str:
    """The leaderboard of `boards.board`: a table for each tier with nine metrics and eight categories; what a run lacks is a dash."""
    from annalist.operators import boards

    heads = ["System (version)", *boards.METRICS.values(), *boards.CATEGORIES]
    parts = ["# Leaderboard"]
    tier = object()
    for r in rows.orderBy("tier", "rank").toLocalIterator():  # a row a run
        if r["tier"] != tier:
            tier = r["tier"]
            parts += [f"\n## Tier: {shown(tier)}\n", f"| {' | '.join(heads)} |", f"|{'---|' * len(heads)}"]
        parts.append(f"| {' | '.join([shown(r['system'])] + ['—' if r[c] is None else shown(r[c]) for c in (*boards.METRICS, *boards.CATEGORIES)])} |")
    return "\n".join(parts if len(parts) > 1 else [*parts, "", "_No results yet._"]) + "\n"


def write(spark, path: str, text: str) -> None:
    """A report as a file, in the place of an older one."""
    from annalist.sources import files

    files.put(spark, path, text, over=True)


def budget(plan: DataFrame, tier: str = "tier", system: str = "system") -> str:
    """Systems by tiers with their costs; what is over the budget in brackets; the included total below."""
    cell = F.when(F.col("included"), F.format_string("%.2f", "cost")).otherwise(F.format_string("(%.2f)", "cost"))
    wide = plan.groupBy(system).pivot(tier).agg(F.first(cell)).orderBy(system)
    total = plan.where("included").agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]
    return f"{markdown(wide)}\n\nIncluded: {total:.2f}"
