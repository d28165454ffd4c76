"""Figures of small result tables as SVG files: lines, bands, steps, boxes, bars, points, heat maps, linear or symlog axes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

#: Most rows that are drawn; larger tables have to be summarised first.
MAX_ROWS = 20_000
WIDTH, HEIGHT, EDGE = 640, 400, 56
COLOURS = ("#33658a", "#c8553d", "#4f772d", "#7b506f", "#b08900", "#444444")


def rows_of(df: DataFrame, *columns: str) -> list[tuple]:
    """The rows to draw, in the order of the columns; more than MAX_ROWS are refused before they are fetched."""
    rows = df.select(*columns).dropna(subset=columns[:1]).limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"over {MAX_ROWS} rows are no figure")
    return sorted(map(tuple, rows), key=lambda r: tuple((v is None, v) for v in r))


def symlog(value: float, linear: float = 1.0) -> float:
    """Linear up to ``linear`` on either side of zero, logarithmic beyond, continuous at the joint."""
    size = abs(value)
    return math.copysign(size if size <= linear else linear * (1 + math.log(size / linear)), value)


@dataclass
class Figure:
    """Layers over common axes; places on the x axis are numbers or labels in the order they are given."""

    title: str
    x_label: str = ""
    y_label: str = ""
    y_scale: Callable[[float], float] = float
    labels: Sequence[str] | None = None
    layers: list[tuple[str, list[tuple], str]] = field(default_factory=list)

    def add(self, kind: str, rows: Iterable[Sequence], name: str = "") -> Figure:
        """kind and rows: line, step, points (x, y); bars (x, y); band (x, low, high); boxes (x, low, q25, median, q75, high); heat (x, y, value).

        Rows with a missing value are left out, as a gap.
        """
        if kind not in _DRAW:
            raise ValueError(f"unknown kind of layer: {kind}")
        self.layers.append((kind, [tuple(r) for r in rows if not any(v is None or isinstance(v, float) and math.isnan(v) for v in r)], name))
        return self

    def _x(self, value: object) -> float:
        return float(self.labels.index(value)) if self.labels is not None else float(value)

    def svg(self) -> str:
        heat = any(kind == "heat" for kind, _, _ in self.layers)
        xs = [self._x(r[0]) for _, rows, _ in self.layers for r in rows]
        ys = [self._x(r[1]) if kind == "heat" else self.y_scale(v) for kind, rows, _ in self.layers for r in rows for v in (r[1:2] if kind == "heat" else r[1:])]
        if any(kind == "bars" for kind, _, _ in self.layers):
            ys.append(0.0)
        pad = 0.5 if self.labels is not None or heat else 0.0
        low_x, high_x = (min(xs) - pad, max(xs) + pad) if xs else (0.0, 1.0)
        low_y, high_y = (min(ys) - (0.5 if heat else 0), max(ys) + (0.5 if heat else 0)) if ys else (0.0, 1.0)
        at_x = lambda v: EDGE + (self._x(v) - low_x) / ((high_x - low_x) or 1) * (WIDTH - 2 * EDGE)
        at_y = lambda v: HEIGHT - EDGE - ((self._x(v) if heat else self.y_scale(v)) - low_y) / ((high_y - low_y) or 1) * (HEIGHT - 2 * EDGE)
        unit = (WIDTH - 2 * EDGE) / ((high_x - low_x) or 1)
        body = [part for i, (kind, rows, name) in enumerate(self.layers) for part in _DRAW[kind](rows, at_x, at_y, unit, COLOURS[i % len(COLOURS)], name)]
        text = lambda x, y, t, more="": f'<text x="{x:.1f}" y="{y:.1f}" font-size="11" {more}>{escape(str(t))}</text>'
        places = self.labels if self.labels is not None else sorted({r[0] for _, rows, _ in self.layers for r in rows})
        shown = places[:: max(1, len(places) // 10)]
        frame = [f'<path class="axes" d="M{EDGE} {EDGE}V{HEIGHT - EDGE}H{WIDTH - EDGE}" fill="none" stroke="#222"/>', text(WIDTH / 2, 24, self.title, 'text-anchor="middle"')]
        frame += [text(at_x(p), HEIGHT - EDGE + 16, p, 'text-anchor="middle"') for p in shown] if xs else []
        frame += [text(WIDTH / 2, HEIGHT - 12, self.x_label, 'text-anchor="middle"'), text(14, HEIGHT / 2, self.y_label, f'transform="rotate(-90 14 {HEIGHT / 2})" text-anchor="middle"')]
        frame += [text(WIDTH - EDGE + 4, EDGE + 14 * i, name, f'fill="{COLOURS[i % len(COLOURS)]}"') for i, (_, _, name) in enumerate(self.layers) if name]
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}">\n' + "\n".join([*frame, *body]) + "\n</svg>\n"

    def write(self, path: str | Path) -> None:
        Path(path).write_text(self.svg(), encoding="utf-8")


def _path(points: list[tuple[float, float]], step: bool = False) -> str:
    parts = []
    for i, (x, y) in enumerate(points):
        parts.append(f"M{x:.1f} {y:.1f}" if not i else f"H{x:.1f}V{y:.1f}" if step else f"L{x:.1f} {y:.1f}")
    return "".join(parts)


def _line(rows, at_x, at_y, unit, colour, name):
    if rows:
        yield f'<path class="line" data-points="{len(rows)}" d="{_path([(at_x(x), at_y(y)) for x, y in rows])}" fill="none" stroke="{colour}" stroke-width="2"/>'


def _step(rows, at_x, at_y, unit, colour, name):
    if rows:
        yield f'<path class="step" data-points="{len(rows)}" d="{_path([(at_x(x), at_y(y)) for x, y in rows], True)}" fill="none" stroke="{colour}"/>'


def _band(rows, at_x, at_y, unit, colour, name):
    if rows:
        edge = [(at_x(x), at_y(high)) for x, _, high in rows] + [(at_x(x), at_y(low)) for x, low, _ in reversed(rows)]
        yield f'<path class="band" data-points="{len(rows)}" d="{_path(edge)}Z" fill="{colour}" fill-opacity="0.2"/>'


def _points(rows, at_x, at_y, unit, colour, name):
    for x, y in rows:
        yield f'<circle class="points" data-points="1" cx="{at_x(x):.1f}" cy="{at_y(y):.1f}" r="3" fill="{colour}" fill-opacity="0.7"/>'


def _bars(rows, at_x, at_y, unit, colour, name):
    for x, y in rows:
        top, foot = sorted((at_y(y), at_y(0.0)))
        yield f'<rect class="bars" data-points="1" x="{at_x(x) - 0.35 * unit:.1f}" y="{top:.1f}" width="{0.7 * unit:.1f}" height="{foot - top:.1f}" fill="{colour}"/>'


def _boxes(rows, at_x, at_y, unit, colour, name):
    for x, low, q25, median, q75, high in rows:
        m, half = at_x(x), 0.25 * unit
        d = f"M{m:.1f} {at_y(low):.1f}V{at_y(q25):.1f}M{m:.1f} {at_y(q75):.1f}V{at_y(high):.1f}M{m - half:.1f} {at_y(q25):.1f}H{m + half:.1f}V{at_y(q75):.1f}H{m - half:.1f}ZM{m - half:.1f} {at_y(median):.1f}H{m + half:.1f}"
        yield f'<path class="boxes" data-points="1" d="{d}" fill="none" stroke="{colour}"/>'


def _heat(rows, at_x, at_y, unit, colour, name):
    most = max((abs(v) for _, _, v in rows), default=0.0) or 1.0
    for x, y, v in rows:
        shade = COLOURS[0] if v >= 0 else COLOURS[1]
        yield f'<rect class="heat" data-points="1" x="{at_x(x) - unit / 2:.1f}" y="{at_y(y) - 16:.1f}" width="{unit:.1f}" height="32" fill="{shade}" fill-opacity="{abs(v) / most:.3f}"><title>{v:.3f}</title></rect>'


_DRAW = {"line": _line, "step": _step, "band": _band, "points": _points, "bars": _bars, "boxes": _boxes, "heat": _heat}
