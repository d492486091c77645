"""All queries on the reference tables but those of the llm subpackage."""

from __future__ import annotations

from folium.plans import cases, documents, markup, more, ranges, scalars, sources

CATALOGUES = [ranges.catalogue, scalars.catalogue, documents.catalogue, markup.catalogue, more.catalogue, cases.catalogue, sources.catalogue]


def queries() -> dict:
    return {n: q for c in CATALOGUES for n, q in c.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for c in CATALOGUES for n, s in c.oracle.items()}
