"""Charts as SVG text or ASCII; frames are thinned out in Spark before they are drawn."""

from __future__ import annotations

from dataclasses import dataclass, field
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COLORS = ("#1f6fb2", "#d1662c", "#3f8f4f", "#8a5aa8", "#b08b2e")


@dataclass
class Plot:
    title: str = ""
    width: int = 640
    height: int = 400
    x_label: str = ""
    y_label: str = ""
    layers: list[tuple[str, list[float], list[float], str]] = field(default_factory=list)

    def _add(self, kind: str, x, y, label: str) -> Plot:
        self.layers.append((kind, [float(v) for v in x], [float(v) for v in y], label))
        return self

    def line(self, x, y, label: str = "") -> Plot:
        return self._add("line", x, y, label)

    def scatter(self, x, y, label: str = "") -> Plot:
        return self._add("scatter", x, y, label)

    def bar(self, x, y, label: str = "") -> Plot:
        return self._add("bar", x, y, label)

    def step(self, x, y, label: str = "") -> Plot:
        return self._add("step", x, y, label)

    def band(self, x, low, high, label: str = "") -> Plot:
        x = list(x)
        return self._add("band", x + x[::-1], [*low, *list(high)[::-1]], label)

    def hline(self, y: float, label: str = "") -> Plot:
        return self._add("hline", [], [y], label)

    @staticmethod
    def acf(values, bound: float, title: str = "ACF") -> Plot:
        return Plot(title).bar(range(len(values)), values).hline(bound).hline(-bound)

    @staticmethod
    def survival(curve: DataFrame, points: int = 500) -> Plot:
        rows = thin(curve, "time", points).collect()
        t = [r["time"] for r in rows]
        return Plot("Survival").band(t, [r["lower"] for r in rows], [r["upper"] for r in rows]).step([0, *t], [1, *[r["survival"] for r in rows]])

    @staticmethod
    def residuals(rows: DataFrame, fitted: str = "fitted", resid: str = "resid", points: int = 2000) -> Plot:
        got = sample(rows.select(fitted, resid), points).collect()
        return Plot("Residuals").scatter([r[0] for r in got], [r[1] for r in got]).hline(0.0)

    def _range(self) -> tuple[float, float, float, float]:
        xs = [v for _, x, _, _ in self.layers for v in x] or [0.0, 1.0]
        ys = [v for k, _, y, _ in self.layers for v in y] + ([0.0] if any(k == "bar" for k, *_ in self.layers) else [])
        ys = ys or [0.0, 1.0]
        x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
        return x0, x1 if x1 > x0 else x0 + 1, y0, y1 if y1 > y0 else y0 + 1

    def to_svg(self) -> str:
        x0, x1, y0, y1 = self._range()
        left, top, w, h = 60, 36, self.width - 80, self.height - 84
        px = lambda v: left + (v - x0) / (x1 - x0) * w
        py = lambda v: top + h - (v - y0) / (y1 - y0) * h
        out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{self.width}" height="{self.height}" font-family="sans-serif" font-size="11">', f'<rect width="{self.width}" height="{self.height}" fill="white"/>', f'<text x="{self.width / 2}" y="20" text-anchor="middle" font-size="14">{escape(self.title)}</text>', f'<rect x="{left}" y="{top}" width="{w}" height="{h}" fill="none" stroke="#888"/>']
        for k in range(5):
            vx, vy = x0 + (x1 - x0) * k / 4, y0 + (y1 - y0) * k / 4
            out += [f'<text x="{px(vx):.1f}" y="{top + h + 16}" text-anchor="middle">{vx:.4g}</text>', f'<text x="{left - 6}" y="{py(vy) + 4:.1f}" text-anchor="end">{vy:.4g}</text>']
        out.append(f'<text x="{left + w / 2}" y="{self.height - 12}" text-anchor="middle">{escape(self.x_label)}</text><text x="14" y="{top + h / 2}" transform="rotate(-90 14 {top + h / 2})" text-anchor="middle">{escape(self.y_label)}</text>')
        for n, (kind, x, y, label) in enumerate(self.layers):
            c = _COLORS[n % len(_COLORS)]
            if kind == "hline":
                out.append(f'<line x1="{left}" x2="{left + w}" y1="{py(y[0]):.1f}" y2="{py(y[0]):.1f}" stroke="{c}" stroke-dasharray="5 4"/>')
            elif kind == "scatter":
                out += [f'<circle cx="{px(a):.1f}" cy="{py(b):.1f}" r="2.5" fill="{c}"/>' for a, b in zip(x, y, strict=True)]
            elif kind == "bar":
                wide = max(1.0, 0.6 * w / max(len(x), 1))
                out += [f'<rect x="{px(a) - wide / 2:.1f}" y="{min(py(b), py(0)):.1f}" width="{wide:.1f}" height="{abs(py(b) - py(0)):.1f}" fill="{c}"/>' for a, b in zip(x, y, strict=True)]
            else:
                points = list(zip(x, y, strict=True))
                if kind == "step":
                    points = [points[0]] + [p for a, b in zip(points, points[1:], strict=False) for p in ((b[0], a[1]), b)] if points else []
                path = " ".join(f"{px(a):.1f},{py(b):.1f}" for a, b in points)
                out.append(f'<polygon points="{path}" fill="{c}" opacity="0.2"/>' if kind == "band" else f'<polyline points="{path}" fill="none" stroke="{c}" stroke-width="1.6"/>')
            if label:
                out.append(f'<text x="{left + 8}" y="{top + 16 + 14 * n}" fill="{c}">{escape(label)}</text>')
        return "\n".join([*out, "</svg>"])

    def save(self, path: str) -> None:
        Path(path).write_text(self.to_svg())

    def to_ascii(self, columns: int = 72, rows: int = 20) -> str:
        x0, x1, y0, y1 = self._range()
        grid = [[" "] * columns for _ in range(rows)]
        for n, (kind, x, y, _) in enumerate(self.layers):
            mark = "-" if kind == "hline" else "*o+x#"[n % 5]
            points = [(x0 + (x1 - x0) * k / (columns - 1), y[0]) for k in range(columns)] if kind == "hline" else list(zip(x, y, strict=True))
            for a, b in points:
                grid[rows - 1 - round((b - y0) / (y1 - y0) * (rows - 1))][round((a - x0) / (x1 - x0) * (columns - 1))] = mark
        return "\n".join([self.title, *[f"{y1 - (y1 - y0) * k / (rows - 1):>10.4g} |{''.join(r)}" for k, r in enumerate(grid)], " " * 11 + "+" + "-" * columns, f"{'':>12}{x0:<.4g}{'':>{columns - 16}}{x1:>.4g}"])


def sample(df: DataFrame, points: int) -> DataFrame:
    """About ``points`` rows of a frame."""
    n = df.count()
    return df if n <= points else df.sample(points / n, 7).limit(2 * points)


def thin(df: DataFrame, order: str, points: int) -> DataFrame:
    """About ``points`` rows spread along an order: the last row of every interval."""
    row = df.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    if row[2] <= points or row[0] == row[1]:
        return df.orderBy(order)
    bucket = F.floor((F.col(order) - F.lit(row[0])) / F.lit((row[1] - row[0]) / points))
    return df.groupBy(bucket.alias("__b")).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("r")).select("r.*").orderBy(order)


def line_svg(y, **options) -> str:
    return Plot(**options).line(range(len(y)), y).to_svg()


def scatter_svg(x, y, **options) -> str:
    return Plot(**options).scatter(x, y).to_svg()
