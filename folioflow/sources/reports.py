"""Reports and bundles. Each renders a table of one row a book, which the driver may hold."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import script_safe


def fixed_width(columns: list[tuple[str, int, bool]]) -> Column:
    """A line of cells (column, width, whether to the right); longer values aren't cut."""
    cells = []
    for name, width, right in columns:
        value = F.coalesce(F.col(name).cast("string"), F.lit("-"))
        full = F.greatest(F.length(value), F.lit(width))
        cells.append((F.lpad if right else F.rpad)(value, full, F.lit(" ")))
    return F.concat_ws(" ", *cells)


def summary_line(audit: DataFrame) -> DataFrame:
    """(books, ok, issues)."""
    return audit.agg(F.count("*").alias("books"), F.count_if(F.col("status") == "OK").alias("ok"), F.count_if(F.col("status") != "OK").alias("issues"))


def audit_markdown(audit: DataFrame) -> str:
    """The audit of ``operators.audit.audit_books`` as Markdown."""
    rows = [r.asDict(recursive=True) for r in audit.orderBy("ord" if "ord" in audit.columns else "id").collect()]
    ok = sum(r["status"] == "OK" for r in rows)
    out = ["# Audit", "", f"{len(rows)} books: {ok} OK, {len(rows) - ok} with issues.", "", "## Sampled verses that their pages don't hold", ""]
    lost = [r for r in rows if r["missing_text"]]
    for r in lost:
        out += [f"### {r['hebrew']} ({r['english']}): {r['id']}", ""]
        for m in r["missing_text"][:10]:
            out += [f"- ch {m['ch']} v{m['n']} ({m['pdf']} pp {m['first']}-{m['last']}): `{m['text']}`"]
        out.append("")
    out += ["_None._", ""] if not lost else []
    out += ["## Empty chapters", "", *(f"- **{r['hebrew']}**: {r['no_verses']}" for r in rows if r["no_verses"]), "", "## Gaps in verse numbers", ""]
    for r in rows:
        if r["gaps"]:
            out.append(f"- **{r['hebrew']}** ({len(r['gaps'])}): " + ", ".join(f"ch{g['ch']} (v{g['got']} for v{g['expected']})" for g in r["gaps"][:5]))
    return "\n".join(out) + "\n"


def bundle(template: str, parts: dict[str, str], data: dict[str, DataFrame]) -> str:
    """``template`` with its marks replaced: parts as they are, data as compact JSON arrays that can stand in a script."""
    for mark, value in parts.items():
        template = template.replace(mark, value)
    for mark, df in data.items():
        rows = df.select(script_safe(F.to_json(F.struct(*df.columns))).alias("j")).collect()
        template = template.replace(mark, "[" + ",".join(r.j for r in rows) + "]")
    return template


def write_text(path: str, text: str) -> None:
    Path(path).write_text(text, encoding="utf-8")
