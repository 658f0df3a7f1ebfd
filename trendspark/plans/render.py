"""Tables, charts and reports of finished results: small rows that were collected for reading."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from html import escape
import math
import unicodedata

from ..functions.rounding import fixed

COLOURS = ("#1b6ca8", "#d1495b", "#3b8e5a", "#e0962f", "#7a5aa6", "#4a4a4a", "#1aa39a", "#a8577e")

@dataclass(frozen=True)
class Facts:
    """What the notes of a report depend on."""

    topic: str
    rows: int
    senses: tuple[str, ...]
    gap_days: int
    broader: int
    unmeasured: int
    below_high: int


#: Notes for a report's reader: on what they depend, and what they say. The first are told whatever the result.
NOTES: tuple[tuple[Callable[[Facts], bool], Callable[[Facts], str]], ...] = (
    (lambda f: bool(f.senses), lambda f: f"Other articles bear the name {f.topic}, among them {', '.join(f.senses)}: check that the one measured is meant."),
    (lambda f: True, lambda f: "Counted are pages opened by people. Opening a page shows interest in reading, and nothing beyond it."),
    (lambda f: True, lambda f: "A row is a language, wherever its readers live; no row is a country."),
    (lambda f: True, lambda f: "Per million: of a million pages opened in the edition in the same months. Compare editions by this figure."),
    (lambda f: f.below_high > 0, lambda f: f"{f.below_high} of {f.rows} rows have a rating below high. Build nothing on a row rated low."),
    (lambda f: f.unmeasured > 0, lambda f: f"{f.unmeasured} of the editions asked for could not be measured. That an article is absent says nothing about its readers."),
    (lambda f: f.broader > 0, lambda f: f"{f.broader} edition(s) treat the topic inside a wider article; the row measures that article."),
    (lambda f: f.gap_days > 0, lambda f: f"A series lacks the counts of up to {f.gap_days} days; in sums these are nothing."),
    (lambda f: True, lambda f: "Ratings follow rules of fixed cost: equal figures have equal ratings."),
)


def limitations(rows: list[dict], unresolved: int = 0, senses: list[str] | None = None, topic: str = "") -> list[str]:
    """The notes that hold for the result rows."""
    facts = Facts(
        topic, len(rows), tuple(senses or ()), max((r.get("window_days_missing") or 0 for r in rows), default=0), sum(r.get("status") == "measures_broader_topic" for r in rows),
        unresolved, sum(r.get("confidence") not in (None, "high") for r in rows),
    )
    return [say(facts) for holds, say in NOTES if holds(facts)]


def width(s: str) -> int:
    """Columns a text takes in a terminal."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def clip(s: str, n: int) -> str:
    """A text in at most ``n`` columns; what is cut ends with an ellipsis."""
    if width(s) <= n:
        return s
    out, taken = [], 0
    for c in s:
        taken += width(c)
        if taken > n - 1:
            break
        out.append(c)
    return "".join(out) + "…"


def padded(s: str, n: int) -> str:
    return s + " " * max(0, n - width(s))


def table(rows: list[dict]) -> str:
    """Results as a table of fixed width, reasons below."""
    heads = ("lang", "title", "median", "raw %", "share %", "confidence", "shape")
    cells = [
        (
            r["lang"] or "", clip(r["title"] or "", 28), fixed(r["median_daily"], 1) or "–", fixed((r["raw"] or {}).get("yoy_pct"), 1) or "–",
            fixed((r["normalized"] or {}).get("yoy_pct"), 1) or "–", r["confidence"] or "–", r["sparkline"] or "",
        )
        for r in rows
    ]
    widths = [max(width(x) for x in col) for col in zip(heads, *cells)]
    lines = ["  ".join(padded(x, w) for x, w in zip(row, widths)).rstrip() for row in (heads, *cells)]
    for r in rows:
        lines += [f"{r['lang']}: {x['detail']}" for x in r["reasons"] or []]
    return "\n".join(lines)


def told_table(rows: list[dict], unresolved: list[dict]) -> str:
    """The told result rows as a table, and what was not measured."""
    full = [
        {"lang": r.get("lang"), "title": r.get("title"), "median_daily": r.get("median_daily_90d"), "raw": r.get("raw"), "normalized": r.get("normalized"), "confidence": r.get("confidence"),
         "sparkline": r.get("sparkline"), "reasons": [{"detail": x} for x in r.get("confidence_reasons", [])]} for r in rows
    ]
    return "\n".join([table(full), *(f"{u['lang']}: {u['reason']}" for u in unresolved)])


def spark_bars(series: dict[str, list[float | None]], w: int = 160, h: int = 24) -> str:
    """One small SVG of bars a series, scaled from 0 to its largest value; an unknown value leaves a gap."""
    out = []
    for name, values in series.items():
        top = max((v for v in values if v is not None), default=0) or 1
        step = w / max(1, len(values))
        bars = "".join(f'<rect x="{k * step:.1f}" y="{h - h * v / top:.1f}" width="{max(0.5, step - 0.5):.1f}" height="{h * v / top:.1f}" fill="{COLOURS[0]}"/>' for k, v in enumerate(values) if v is not None)
        out.append(f'<p>{escape(name)} <svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}">{bars}</svg></p>')
    return "".join(out)


def segments(points: list[tuple[int, float | None]]) -> list[list[tuple[int, float]]]:
    """Runs of known points; a gap breaks the line."""
    out: list[list[tuple[int, float]]] = [[]]
    for x, y in points:
        if y is None or not math.isfinite(y):
            out.append([])
        else:
            out[-1].append((x, y))
    return [s for s in out if s]


def line_chart(lines: dict[str, list[tuple[int, float | None]]], labels: list[str], title: str, w: int = 640, h: int = 280) -> str:
    """SVG of lines over the positions of ``labels``, scaled from 0."""
    top = max((y for pts in lines.values() for _, y in pts if y is not None and math.isfinite(y)), default=1.0)
    step = 10 ** math.floor(math.log10(top)) if top > 0 else 1
    top = math.ceil(top / step) * step if top > 0 else 1
    px = lambda i: 50 + (w - 70) * i / max(1, len(labels) - 1)
    py = lambda v: h - 40 - (h - 80) * v / top
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" font-family="sans-serif" font-size="11">', f'<text x="50" y="20" font-size="14">{escape(title)}</text>']
    for k in range(5):
        v = top * k / 4
        parts.append(f'<line x1="50" x2="{w - 20}" y1="{py(v):.1f}" y2="{py(v):.1f}" stroke="#ddd"/><text x="44" y="{py(v) + 4:.1f}" text-anchor="end">{v:g}</text>')
    for i in sorted({0, len(labels) // 2, len(labels) - 1} if labels else set()):
        parts.append(f'<text x="{px(i):.1f}" y="{h - 22}" text-anchor="middle">{escape(labels[i])}</text>')
    for k, (name, pts) in enumerate(lines.items()):
        c = COLOURS[k % len(COLOURS)]
        for s in segments(pts):
            xy = " ".join(f"{px(x):.1f},{py(y):.1f}" for x, y in s)
            parts.append(f'<polyline fill="none" stroke="{c}" stroke-width="1.6" points="{xy}"/>')
        parts.append(f'<text x="{50 + 90 * k}" y="{h - 6}" fill="{c}">{escape(name)}</text>')
    return "\n".join([*parts, "</svg>"])


def bar_chart(bars: dict[str, float | None], title: str, w: int = 640, row: int = 24) -> str:
    """SVG of horizontal bars around 0; a missing value has no bar."""
    top = max((abs(v) for v in bars.values() if v is not None), default=1.0) or 1.0
    h, mid = 40 + row * len(bars), 100 + (w - 180) / 2
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" font-family="sans-serif" font-size="11">', f'<text x="10" y="18" font-size="14">{escape(title)}</text>']
    for k, (name, v) in enumerate(bars.items()):
        y = 30 + row * k
        parts.append(f'<text x="90" y="{y + 14}" text-anchor="end">{escape(name)}</text>')
        if v is not None:
            size = (w - 180) / 2 * abs(v) / top
            x = mid if v >= 0 else mid - size
            parts.append(f'<rect x="{x:.1f}" y="{y + 3}" width="{size:.1f}" height="{row - 8}" fill="{COLOURS[0] if v >= 0 else COLOURS[1]}"/><text x="{w - 70}" y="{y + 14}">{fixed(v, 1)} %</text>')
    return "\n".join([*parts, "</svg>"])


def matrix(periods: list[str], groups: list[str], values: dict[tuple[str, str], float | None]) -> str:
    """HTML table of periods by groups; what is absent is a dash, not 0."""
    head = "".join(f"<th>{escape(g)}</th>" for g in groups)
    body = "".join(f"<tr><th>{escape(p)}</th>" + "".join(f"<td>{'–' if values.get((p, g)) is None else f'{values[p, g]:g}'}</td>" for g in groups) + "</tr>" for p in periods)
    return f"<table><tr><th></th>{head}</tr>{body}</table>"


def report(topic: str, rows: list[dict], charts: list[str], data: str = "", notes: str = "", limits: list[str] | None = None) -> str:
    """One HTML page: table, charts, notes, limits, data."""
    items = "".join(f"<li>{escape(x)}</li>" for x in (limits if limits is not None else limitations(rows, topic=topic)))
    return (
        f'<!doctype html><html><head><meta charset="utf-8"><title>{escape(topic)}</title></head><body><h1>{escape(topic)}</h1><pre>{escape(table(rows))}</pre>'
        f"{''.join(charts)}<p>{escape(notes)}</p><h2>Limits</h2><ul>{items}</ul>{data}</body></html>"
    )
