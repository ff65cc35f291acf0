"""Job rows and reports as files: CSV, JSON and HTML; Excel and PDF where their libraries are installed."""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.functions.text import blank, filled

#: The columns of exported jobs, in order.
COLUMNS = (
    "company", "canonical_company", "role", "normalized_role", "location", "work_mode", "country", "employment_type", "experience_min_years",
    "experience_max_years", "seniority", "salary_min", "salary_max", "currency", "posted_date", "match_score", "similarity", "skill_match",
    "skills", "technologies", "source", "ats_type", "apply_url", "career_url",
)


def job_rows(jobs: DataFrame) -> DataFrame:
    """seq and the flat columns of an export; lists are joined by "; "."""
    match = (lambda c: F.col(f"match.{c}")) if "match" in jobs.columns else (lambda c: F.lit(None).cast("double"))
    where = F.coalesce(filled(F.col("location.city"), F.col("location.country")), F.when(F.col("location.is_remote"), F.lit("Remote")), F.lit(""))
    values: dict[str, Column] = {
        "company": F.col("company_name"), "canonical_company": blank(F.col("canonical_company_name")), "location": where, "country": blank(F.col("country")),
        "experience_min_years": F.col("experience.min_years"), "experience_max_years": F.col("experience.max_years"),
        "salary_min": F.col("salary.min_amount"), "salary_max": F.col("salary.max_amount"), "currency": blank(F.col("salary.currency")),
        "posted_date": F.coalesce(F.date_format("posted_date", "yyyy-MM-dd"), F.lit("")), "match_score": match("score"), "similarity": match("similarity"),
        "skill_match": match("skill"), "skills": F.array_join("skills", "; "), "technologies": F.array_join("technologies", "; "), "apply_url": F.col("url"),
        "career_url": blank(F.col("career_url")),
    }
    return jobs.select("seq", *[values.get(c, F.col(c)).alias(c) for c in COLUMNS])


def write_csv(rows: DataFrame, path: str, compression: str = "none") -> None:
    """CSV files with a header, written by all tasks."""
    rows.write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def write_ndjson(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def seed_rows(companies: DataFrame) -> DataFrame:
    """Companies with their lists joined by ";" for CSV."""
    return companies.select(*[F.array_join(f.name, ";").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in companies.schema])


def write_seeds(companies: DataFrame, folder: str, name: str = "companies") -> None:
    """Companies as CSV and JSON lines by all tasks, and as one YAML document, written row by row."""
    import yaml

    write_csv(seed_rows(companies), f"{folder}/{name}.csv")
    write_ndjson(companies, f"{folder}/{name}.json")
    with open(f"{folder}/{name}.yaml", "w", encoding="utf-8") as f:
        f.write("companies:\n")
        for row in _rows(companies):
            f.write(yaml.safe_dump([row], sort_keys=False, allow_unicode=True))


@dataclass
class Report:
    """What a report shows: facts about it, and tables by title in order.

    Tables stay DataFrames; exporters read all their rows, a partition at a time.
    """

    meta: dict
    tables: dict[str, DataFrame]
    title: str = "Job report"


def report(jobs: DataFrame, parts: dict[str, DataFrame], meta: dict, title: str = "Job report") -> Report:
    return Report(meta, {**parts, "jobs": jobs}, title)


def _rows(table: DataFrame) -> Iterator[dict]:
    return (r.asDict(recursive=True) for r in table.toLocalIterator())


def write_json(data: Report, path: str) -> None:
    """One JSON object: meta, and a list of rows for each table."""
    said = lambda x: json.dumps(x, default=str, ensure_ascii=False)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'{{"meta": {said(data.meta)}')
        for name, table in data.tables.items():
            f.write(f",\n{said(name)}: [")
            for k, row in enumerate(_rows(table)):
                f.write(("," if k else "") + "\n" + said(row))
            f.write("]")
        f.write("}\n")


def write_html(data: Report, path: str, theme: str = "light") -> None:
    """One self-contained page with all rows of each table."""
    ink, paper = ("#111", "#fff") if theme == "light" else ("#eee", "#111")
    cells = lambda tag, values: "".join(f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>" for x in values)
    style = f"body{{font-family:sans-serif;color:{ink};background:{paper}}}td,th{{padding:.2em .6em;border-bottom:1px solid #8888}}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(data.title)}</title><style>{style}</style></head><body><h1>{html.escape(data.title)}</h1>")
        f.write(f"<table>{''.join(f'<tr>{cells('td', kv)}</tr>' for kv in data.meta.items())}</table>")
        for name, table in data.tables.items():
            f.write(f"<h2>{html.escape(name)}</h2><table><tr>{cells('th', table.columns)}</tr>")
            for row in _rows(table):
                f.write(f"<tr>{cells('td', row.values())}</tr>\n")
            f.write("</table>")
        f.write("</body></html>")


#: Fixed value: how many rows a sheet can hold.
SHEET_ROWS = 1_048_576


def write_excel(data: Report, path: str) -> None:
    """A workbook with a summary and a sheet for each table; one too long for a sheet goes on in the next."""
    import openpyxl

    book = openpyxl.Workbook(write_only=True)
    summary = book.create_sheet("Summary")
    for pair in ((data.title, ""), *data.meta.items()):
        summary.append([str(x) for x in pair])
    for name, table in data.tables.items():
        sheet, left, part = None, 0, 0
        for row in chain([None], _rows(table)):
            if not left:
                part += 1
                sheet, left = book.create_sheet(f"{name[:27]} {part}" if part > 1 else name[:31]), SHEET_ROWS - 1
                sheet.append(table.columns)
            if row is not None:
                sheet.append([str(v) if isinstance(v, (dict, list)) else v for v in row.values()])
                left -= 1
    book.save(path)


def write_pdf(data: Report, path: str, rows: int = 500) -> None:
    """All tables, whole cells wrapped, each in parts of ``rows`` rows that repeat the header."""
    from reportlab.lib.styles import getSampleStyleSheet
    from reportlab.platypus import Paragraph, SimpleDocTemplate, Table

    styles = getSampleStyleSheet()
    cell = lambda v: Paragraph(html.escape("" if v is None else str(v)), styles["BodyText"])
    story = [Paragraph(html.escape(data.title), styles["Title"])]
    for name, table in data.tables.items():
        story.append(Paragraph(html.escape(name), styles["Heading2"]))
        lines = ([cell(v) for v in row.values()] for row in _rows(table))
        while part := list(islice(lines, rows)):
            story.append(Table([[cell(c) for c in table.columns], *part], repeatRows=1))
    SimpleDocTemplate(path).build(story)


EXPORTERS: dict[str, Callable[[Report, str], None]] = {"json": write_json, "html": write_html, "excel": write_excel, "pdf": write_pdf}


def export(fmt: str, data: Report, path: str) -> None:
    """Writes a report; ``excel`` and ``pdf`` raise ImportError without their libraries."""
    if fmt not in EXPORTERS:
        raise ValueError(f"unknown format {fmt!r}; known are {sorted(EXPORTERS)}")
    EXPORTERS[fmt](data, path)


def workbook(jobs: DataFrame, parts: dict[str, DataFrame], meta: dict, best: int = 50) -> Report:
    """The standard report: best matches, all jobs, duplicates, counts and histories, in the order of its sheets."""
    rows = job_rows(jobs)
    order = ("duplicates", "companies", "skill_gap", "collectors", "pipeline", "history")
    titles = ("Duplicate Jobs", "Company Statistics", "Skill Gap Analysis", "Collector Statistics", "Pipeline Performance", "Historical Trends")
    shown = {t: parts[k] for k, t in zip(order, titles, strict=True) if k in parts}
    return Report(meta, {"Top Matches": rows.orderBy(F.desc("match_score"), "seq").limit(best), "All Jobs": rows, **shown})


def prometheus(counters: dict[str, float], summaries: dict[str, tuple[int, float]] | None = None) -> str:
    """Metrics in the text format: counters, and (count, sum) summaries."""
    lines = [x for k, v in sorted(counters.items()) for x in (f"# TYPE {k} counter", f"{k} {v:g}")]
    for k, (n, total) in sorted((summaries or {}).items()):
        lines += [f"# TYPE {k} summary", f"{k}_count {n}", f"{k}_sum {total:g}"]
    return "\n".join(lines) + "\n"
