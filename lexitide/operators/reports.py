"""Community characteristics, experience by month, smoothing, and small HTML and SVG reports."""

from __future__ import annotations

import html

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.functions import dates
from lexitide.operators.medians import medians


def user_statistics(users: DataFrame) -> DataFrame:
    """Means and medians over authors of comments, submissions and days between first and last post."""
    columns = ["comments", "submissions", "days"]
    rows = users.select("comments", "submissions", dates.days_between(F.col("first_post"), F.col("last_post")).alias("days"))
    means = rows.agg(F.count("*").alias("users"), *(F.bround(F.avg(c), 2).alias(f"mean_{c}") for c in columns))
    middle = medians(rows, {f"median_{c}": F.col(c) for c in columns})
    return means.crossJoin(F.broadcast(middle)).select("users", *(f"{n}_{c}" for c in columns for n in ("mean", "median")))  # two single rows


def post_statistics(posts: DataFrame, words: str = "text") -> DataFrame:
    rows = posts.select(F.size(words).cast("double").alias("n"))
    means = rows.agg(F.count("*").alias("posts"), F.bround(F.avg("n"), 2).alias("mean_tokens"))
    return means.crossJoin(F.broadcast(medians(rows, {"median_tokens": F.col("n")})))


def experience_summary(rows: DataFrame, threshold: float, by: list[str] | None = None, value: str = "experience") -> DataFrame:
    """Share of posts above the threshold (3 decimals), mean and median experience (1 decimal)."""
    by = by or []
    rows = rows.where(F.col(value).isNotNull()).select(*by, value)
    means = rows.groupBy(*by).agg(F.bround(F.count_if(F.col(value) > threshold) / F.count("*"), 3).alias("fraction"), F.bround(F.avg(value), 1).alias("avg_exp"))
    middle = medians(rows, {"median_exp": F.col(value)}, by).withColumn("median_exp", F.bround("median_exp", 1))
    return means.join(middle, by) if by else means.crossJoin(F.broadcast(middle))


def experience_by_month(rows: DataFrame, threshold: float, first: str, last: str, when: str = "true_date", value: str = "experience") -> DataFrame:
    """experience_summary by calendar month, from the start of first to the first instant of last; months as Y-M."""
    span = rows.where((F.col(when) >= F.lit(first).cast("timestamp_ntz")) & (F.col(when) <= F.lit(last).cast("timestamp_ntz")))
    month = F.concat_ws("-", F.year(when), F.month(when))
    return experience_summary(span.withColumn("true_month", month), threshold, ["true_month"], value)


def lowess(x, y, fraction: float = 0.1, rounds: int = 3) -> np.ndarray:
    """Locally weighted linear smoothing with tricube weights and bisquare robustness rounds."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    if n < 2:
        return y.copy()
    k = min(n, max(2, int(fraction * n + 1e-10)))
    robust, out = np.ones(n), np.empty(n)
    for _ in range(rounds + 1):
        for i in range(n):
            d = np.abs(x - x[i])
            h = np.sort(d)[k - 1]
            w = np.where(d <= h * 0.001, 1.0, np.where(d < h * 0.999, (1 - np.minimum(1, d / h if h else d) ** 3) ** 3, 0.0)) * robust
            if w.sum() <= 0:
                out[i] = y[i]
                continue
            w = w / w.sum()
            m = (w * x).sum()
            s = (w * (x - m) ** 2).sum()
            slope = (w * (x - m) * y).sum() / s if s > 1e-12 * (np.ptp(x) ** 2 or 1) else 0.0
            out[i] = (w * y).sum() + slope * (x[i] - m)
        left = np.abs(y - out)
        scale = 6 * np.median(left)
        if scale <= 1e-12:
            break
        robust = np.clip(1 - (left / scale) ** 2, 0, 1) ** 2
    return out


def smoothed(rows: DataFrame, x: str, y: str, by: str, fraction: float = 0.1) -> DataFrame:
    """rows(by, x, y) with the column fit. A group is one trajectory: hundreds of points at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x)
        return pdf.assign(fit=lowess(pdf[x], pdf[y], fraction))

    kind = dict(rows.dtypes)
    return rows.select(by, x, y).groupBy(by).applyInPandas(run, f"{by} {kind[by]}, {x} {kind[x]}, {y} {kind[y]}, fit double")


def html_table(columns: list[str], rows, title: str = "", head: int | None = None) -> str:
    """An HTML table; values are escaped, floats shown with six digits."""
    show = lambda v: html.escape(f"{v:.6g}" if isinstance(v, float) else "" if v is None else str(v))
    body = "".join("<tr>" + "".join(f"<td>{show(v)}</td>" for v in r) + "</tr>" for r in list(rows)[:head])
    top = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    return (f"<h2>{html.escape(title)}</h2>" if title else "") + f"<table><tr>{top}</tr>{body}</table>"


def as_table(data, title: str = "", head: int | None = None) -> str:
    """html_table of a small DataFrame, a dict, a list of dicts, a list, or pairs. DataFrames are cut to head rows first."""
    if isinstance(data, DataFrame):
        return html_table(data.columns, (data.limit(head) if head else data).collect(), title)
    if isinstance(data, dict):
        return html_table(["key", "value"], data.items(), title, head)
    data = list(data)
    if data and isinstance(data[0], dict):
        names = list(dict.fromkeys(k for d in data for k in d))
        return html_table(names, [[d.get(k) for k in names] for d in data], title, head)
    return html_table(["value"], [[v] for v in data], title, head)


def svg_scatter(x, y, errors=None, line=None, width: int = 640, height: int = 360, size: float = 4, labels: tuple[str, str] = ("x", "y")) -> str:
    """A scatter plot with optional error bars and a line through line's values."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    e = np.zeros(len(y)) if errors is None else np.nan_to_num(np.asarray(errors, float))
    lo, hi = (float((y - e).min()), float((y + e).max())) if len(y) else (0.0, 1.0)
    at = lambda v, a, b, p, q: p + (v - a) / ((b - a) or 1) * (q - p)
    px = [at(v, x.min(), x.max(), 50, width - 10) for v in x]
    py = lambda v: at(v, lo, hi, height - 40, 10)
    parts = [f'<line x1="{a:.1f}" y1="{py(v - d):.1f}" x2="{a:.1f}" y2="{py(v + d):.1f}" stroke="#999"/>' for a, v, d in zip(px, y, e, strict=True) if d]
    parts += [f'<circle cx="{a:.1f}" cy="{py(v):.1f}" r="{size / 2}" fill="#357"/>' for a, v in zip(px, y, strict=True)]
    if line is not None:
        parts.append('<polyline fill="none" stroke="#c33" points="' + " ".join(f"{a:.1f},{py(v):.1f}" for a, v in zip(px, line, strict=True)) + '"/>')
    parts += [f'<text x="{width / 2}" y="{height - 6}">{html.escape(labels[0])}</text>', f'<text x="4" y="14">{html.escape(labels[1])}</text>']
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">' + "".join(parts) + "</svg>"


def page(*parts: str, title: str = "report") -> str:
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body>{''.join(parts)}</body></html>"
