"""A static HTML summary of public aggregates; reads only what it is given."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

#: Rows of a summary; a longer table is no summary and is refused.
MOST_ROWS = 1000


def html_summary(title: str, **tables: DataFrame) -> str:
    parts = []
    for name, df in tables.items():
        rows = df.orderBy(*df.columns).limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise ValueError(f"{name} has more than {MOST_ROWS} rows")
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{'' if v is None else escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<section><h2>{escape(name)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table></section>")
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{"".join(parts)}</body></html>'
