"""Charts as SVG: stacked area of a session's context, budget gauge, donut, arc graph of links."""

from __future__ import annotations

import html
import math

COLOURS = ["#6b7280", "#2563eb", "#0891b2", "#059669", "#65a30d", "#ca8a04", "#ea580c", "#dc2626", "#9333ea", "#d1d5db"]


def _svg(width: float, height: float, body: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:g} {height:g}" width="{width:g}" height="{height:g}">{"".join(body)}</svg>'


def timeline(turns: list[dict], shares: list[str], window: int, limit: float, compactions: list[int] = (), width: int = 900, height: int = 260) -> str:
    """Shares of the context by turn, stacked, with the limit's line and a mark at each compaction."""
    top = max([window * limit, *(t["ctx"] for t in turns)], default=1) or 1
    x = lambda i: width * i / max(1, len(turns) - 1)
    y = lambda v: height - height * v / top
    base, body = [0.0] * len(turns), []
    for share, colour in zip(shares, COLOURS):
        upper = [b + t[share] for b, t in zip(base, turns)]
        there = [f"{x(i):.1f},{y(v):.1f}" for i, v in enumerate(upper)]
        back = [f"{x(i):.1f},{y(v):.1f}" for i, v in reversed(list(enumerate(base)))]
        body.append(f'<polygon fill="{colour}" points="{" ".join(there + back)}"><title>{html.escape(share)}</title></polygon>')
        base = upper
    body.append(f'<line x1="0" x2="{width}" y1="{y(window * limit):.1f}" y2="{y(window * limit):.1f}" stroke="#b91c1c" stroke-dasharray="4"/>')
    body += [f'<line x1="{x(i):.1f}" x2="{x(i):.1f}" y1="0" y2="{height}" stroke="#111"/>' for i in compactions if i < len(turns)]
    return _svg(width, height, body)


def gauge(share: float, zone: str, width: int = 300, height: int = 24) -> str:
    """A bar filled to a share, coloured by its zone."""
    colour = {"ok": "#059669", "warn": "#ca8a04"}.get(zone, "#dc2626")
    fill = width * min(1.0, max(0.0, share))
    return _svg(width, height, [f'<rect width="{width}" height="{height}" fill="#e5e7eb"/>', f'<rect width="{fill:.1f}" height="{height}" fill="{colour}"/>'])


def donut(parts: list[tuple[str, float]], size: int = 160) -> str:
    """Parts of a whole as a ring; nothing when they sum to nothing."""
    total, r = sum(v for _, v in parts), size / 2 - 16
    round_, at, body = 2 * math.pi * r, 0.0, []
    for (label, value), colour in zip(parts, COLOURS * (len(parts) // len(COLOURS) + 1)):
        if total and value:
            arc = round_ * value / total
            body.append(f'<circle cx="{size / 2}" cy="{size / 2}" r="{r}" fill="none" stroke="{colour}" stroke-width="24" stroke-dasharray="{arc:.2f} {round_ - arc:.2f}" stroke-dashoffset="{-at:.2f}"><title>{html.escape(label)}: {value:g}</title></circle>')
            at += arc
    return _svg(size, size, body)


def arcs(nodes: list[dict], edges: list[tuple[str, str]], width: int = 900) -> str:
    """Notes on a line, sized by their bytes, with an arc for each link."""
    largest = max((n["bytes"] for n in nodes), default=1) or 1
    place = {n["slug"]: width * (i + 0.5) / max(1, len(nodes)) for i, n in enumerate(nodes)}
    ground, body = 180, []
    for a, b in edges:
        if a in place and b in place and a != b:
            lift = min(150.0, 30 + 0.42 * abs(place[a] - place[b]))
            body.append(f'<path d="M {place[a]:.1f} {ground} Q {(place[a] + place[b]) / 2:.1f} {ground - 2 * lift:.1f} {place[b]:.1f} {ground}" fill="none" stroke="#94a3b8"/>')
    for n in nodes:
        radius = 6 + 12 * math.sqrt(n["bytes"] / largest)
        body.append(f'<circle cx="{place[n["slug"]]:.1f}" cy="{ground}" r="{radius:.1f}" fill="#2563eb"><title>{html.escape(n["slug"])}</title></circle>')
    return _svg(width, ground + 30, body)
