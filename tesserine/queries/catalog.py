"""All queries and their SQL."""

from __future__ import annotations

from . import images, models, prep, reports, similarity, sqlforms

QUERIES = {**prep.QUERIES, **similarity.QUERIES, **models.QUERIES, **reports.QUERIES, **images.QUERIES, **sqlforms.QUERIES}
SQL = {**prep.SQL, **similarity.SQL, **models.SQL, **reports.SQL, **images.SQL, **sqlforms.SQL}
