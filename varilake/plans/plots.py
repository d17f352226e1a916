"""Plots as SVG text, from tables with a row per sample or a bounded number of points per sample."""

from __future__ import annotations

import math
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varilake.model import Genotypes
from varilake.operators import stats

WIDTH, HEIGHT, LEFT, BOTTOM, TOP = 864, 576, 70, 110, 40
BINS = 40
COLOURS = ("#4477aa", "#ee6677", "#228833", "#ccbb44", "#66ccee", "#aa3377", "#bbbbbb")


def _frame(title: str, y_label: str, top: float, names: list[str], body: list[str]) -> str:
    step = (WIDTH - LEFT - 10) / max(len(names), 1)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" font-size="11">', f'<text x="{WIDTH / 2}" y="20" text-anchor="middle" font-size="14">{escape(title)}</text>']
    for i in range(5):
        y = HEIGHT - BOTTOM - i / 4 * (HEIGHT - BOTTOM - TOP)
        out.append(f'<line x1="{LEFT}" x2="{WIDTH - 10}" y1="{y:.1f}" y2="{y:.1f}" stroke="#dddddd"/><text x="{LEFT - 6}" y="{y + 4:.1f}" text-anchor="end">{top * i / 4:.3g}</text>')
    out.append(f'<text transform="rotate(-90)" x="{-HEIGHT / 2}" y="16" text-anchor="middle">{escape(y_label)}</text>')
    for i, n in enumerate(names):
        x, y = LEFT + (i + 0.5) * step, HEIGHT - BOTTOM + 12
        out.append(f'<text transform="rotate(-60 {x:.1f} {y})" x="{x:.1f}" y="{y}" text-anchor="end" font-size="{min(11, max(4, step)):.1f}">{escape(n)}</text>')
    return "\n".join([*out, *body, "</svg>"]) + "\n"


def _colour_of(groups: list[str | None]) -> dict[str | None, str]:
    return {g: COLOURS[i % len(COLOURS)] for i, g in enumerate(dict.fromkeys(groups))}


def bar_chart(rows: list[tuple[str, str | None, float | None]], title: str, y_label: str) -> str:
    """rows: (name, group, value); a value that is missing has no bar."""
    colour, step = _colour_of([g for _, g, _ in rows]), (WIDTH - LEFT - 10) / max(len(rows), 1)
    top = max((v for _, _, v in rows if v), default=0) or 1
    bars = [f'<rect x="{LEFT + (i + 0.1) * step:.1f}" y="{HEIGHT - BOTTOM - v / top * (HEIGHT - BOTTOM - TOP):.1f}" width="{0.8 * step:.1f}" height="{v / top * (HEIGHT - BOTTOM - TOP):.1f}" fill="{colour[g]}"/>' for i, (_, g, v) in enumerate(rows) if v]
    return _frame(title, y_label, top, [n for n, _, _ in rows], bars)


def violin_chart(rows: list[tuple[str, str | None, dict[int, int]]], top: float, title: str, y_label: str) -> str:
    """rows: (name, group, counts by bin from 0 to BINS - 1 of the values from 0 to top)."""
    colour, step = _colour_of([g for _, g, _ in rows]), (WIDTH - LEFT - 10) / max(len(rows), 1)
    body = []
    for i, (_, g, counts) in enumerate(rows):
        most, x = max(counts.values(), default=0), LEFT + (i + 0.5) * step
        half = [(HEIGHT - BOTTOM - (b + 0.5) / BINS * (HEIGHT - BOTTOM - TOP), 0.45 * step * counts.get(b, 0) / most) for b in range(BINS)] if most else []
        points = [(x - w, y) for y, w in half] + [(x + w, y) for y, w in reversed(half)]
        body.append(f'<polygon points="{" ".join(f"{a:.1f},{b:.1f}" for a, b in points)}" fill="{colour[g]}"/>')
    return _frame(title, y_label, top, [n for n, _, _ in rows], body)


def _ordered(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("group").asc_nulls_last(), "sample")


def assess_missing(data: Genotypes, folder: str, project: str = "project") -> DataFrame:
    """The missing table, written as CSV and as a bar chart: <folder>/<project>_missing.csv and .svg."""
    table = stats.missing_table(data)
    stats.write_table(table, f"{folder}/{project}_missing.csv")
    rows = [(r["sample"], r["group"], r["missing_p"]) for r in _ordered(table).collect()]  # one row per sample
    Path(f"{folder}/{project}_missing.svg").write_text(bar_chart(rows, f"Missing genotypes, {project}", "share missing"))
    return table


def assess_coverage(data: Genotypes, folder: str, project: str = "project", max_points_per_sample: int = 5000, seed: int = 0) -> DataFrame:
    """Depths of called genotypes, at most about max_points_per_sample of each sample, as violins of their logarithm:
    <folder>/<project>_coverage.svg. No depth at all is an error. The points are binned before the driver sees them."""
    points = stats.coverage_points(data, max_points_per_sample, seed)
    top = points.agg(F.max("log10_dp")).first()[0]
    if top is None:
        raise ValueError("no called genotype has a depth")
    scale = max(top, math.log10(2))
    bins = points.where("log10_dp IS NOT NULL").groupBy("sample", "group", F.least(F.floor(F.greatest("log10_dp", F.lit(0.0)) / scale * BINS), F.lit(BINS - 1)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("m"))
    rows = _ordered(bins.groupBy("sample", "group").agg(F.collect_list(F.struct("b", "m")).alias("c"))).collect()  # at most BINS counts per sample
    Path(f"{folder}/{project}_coverage.svg").write_text(violin_chart([(r["sample"], r["group"], dict(r["c"])) for r in rows], scale, f"Depth of called genotypes, {project}", "log10 depth"))
    return points
