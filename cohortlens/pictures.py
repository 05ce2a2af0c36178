"""Pictures of a run as SVG, from its figure tables: no plotting library, light and dark by the reader's setting, a tooltip on every mark. Each
table behind a picture is written whole beside it."""

from __future__ import annotations

import html
import math
from collections.abc import Callable, Sequence

STYLE = """.viz{font:12px system-ui,sans-serif;background:var(--s);--s:#fcfcfb;--i:#0b0b0b;--i2:#52514e;--g:#e1e0d9;--a:#c3c2b7;--c1:#2a78d6;--c2:#eb6834;--c3:#1baf7a;--c4:#eda100;--c5:#e87ba4;--c6:#008300;--c7:#4a3aa7;--c8:#e34948;--c0:#898781}
@media(prefers-color-scheme:dark){.viz{--s:#1a1a19;--i:#fff;--i2:#c3c2b7;--g:#2c2c2a;--a:#383835;--c1:#3987e5;--c2:#d95926;--c3:#199e70;--c4:#c98500;--c5:#d55181;--c7:#9085e9;--c8:#e66767}}
.viz text{fill:var(--i2)}.viz .t{fill:var(--i);font-weight:600}.viz .g{stroke:var(--g)}.viz .a{stroke:var(--a)}.viz .l{fill:none;stroke-width:2;stroke-linejoin:round;stroke-linecap:round}.viz .d{stroke:var(--s);stroke-width:2}"""
WIDTH, HEIGHT, LEFT, RIGHT, TOP, BOTTOM = 520, 340, 62, 16, 54, 46
#: Colours, in fixed order; what has none is gray. Points of a line that are drawn.
COLOURS, POINTS = 8, 400


def esc(x) -> str:
    return html.escape(f"{x:.4g}" if isinstance(x, float) else str(x))


def ticks(low: float, high: float, n: int = 5) -> list[float]:
    """About n round numbers from low to high."""
    span = (high - low) or 1.0
    step = 10 ** math.floor(math.log10(span / n))
    step *= next(m for m in (1, 2, 5, 10) if span / (m * step) <= n)
    return [round(k * step, 12) for k in range(math.ceil(low / step - 1e-9), math.floor(high / step + 1e-9) + 1)]


def colour(k: int) -> str:
    return f"var(--c{k if 1 <= k <= COLOURS else 0})"


def frame(title: str, x: str, y: str, xs: tuple[float, float], ys: tuple[float, float], body: Callable, legend: Sequence[tuple[str, int]] = (), height: int = HEIGHT, left: int = LEFT, names: Sequence[str] = ()) -> str:
    """A picture: title, legend for two series or more, axes with round numbers (or names down the side), and body(px, py)."""
    pad = lambda a, b: (a - 0.5, b + 0.5) if a == b else (a, b)
    (x0, x1), (y0, y1) = pad(*xs), pad(*ys)
    px = lambda v: left + (v - x0) / (x1 - x0) * (WIDTH - left - RIGHT)
    py = lambda v: height - BOTTOM - (v - y0) / (y1 - y0) * (height - TOP - BOTTOM)
    out = [f'<svg class="viz" xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {height}" width="{WIDTH}" height="{height}" role="img" aria-label="{esc(title)}"><style>{STYLE}</style>', f'<text class="t" x="12" y="20">{esc(title)}</text>']
    at = 12
    for name, k in legend if len(legend) > 1 else ():
        out.append(f'<circle cx="{at + 5}" cy="36" r="5" fill="{colour(k)}"/><text x="{at + 15}" y="40">{esc(name)}</text>')
        at += 30 + 7 * len(str(name))
    for v in ticks(x0, x1):
        out.append(f'<line class="g" x1="{px(v):.1f}" x2="{px(v):.1f}" y1="{TOP}" y2="{height - BOTTOM}"/><text x="{px(v):.1f}" y="{height - BOTTOM + 16}" text-anchor="middle">{esc(float(v))}</text>')
    for k, name in enumerate(names):
        out.append(f'<text x="{left - 8}" y="{py(len(names) - 1 - k) + 4:.1f}" text-anchor="end">{esc(name)}</text>')
    for v in () if names else ticks(y0, y1):
        out.append(f'<line class="g" x1="{left}" x2="{WIDTH - RIGHT}" y1="{py(v):.1f}" y2="{py(v):.1f}"/><text x="{left - 8}" y="{py(v) + 4:.1f}" text-anchor="end">{esc(float(v))}</text>')
    base = max(x0, min(0.0, x1)) if names else x0
    out.append(f'<line class="a" x1="{px(base):.1f}" x2="{px(base):.1f}" y1="{TOP}" y2="{height - BOTTOM}"/>')
    out.append(f'<text x="{(left + WIDTH - RIGHT) / 2}" y="{height - 8}" text-anchor="middle">{esc(x)}</text>' + (f'<text transform="translate(14 {(TOP + height - BOTTOM) / 2}) rotate(-90)" text-anchor="middle">{esc(y)}</text>' if y else ""))
    return "".join([*out, *body(px, py), "</svg>"])


def mark(px: float, py: float, k: int, label: str) -> str:
    return f'<circle class="d" cx="{px:.1f}" cy="{py:.1f}" r="4.5" fill="{colour(k)}"><title>{esc(label)}</title></circle>'


def thin(points: list, most: int = POINTS) -> list:
    """At most so many of the points, the ends among them."""
    return points if len(points) <= most else [points[round(i * (len(points) - 1) / (most - 1))] for i in range(most)]


def lines(title: str, x: str, y: str, series: Sequence[tuple[str, list[tuple[float, float]]]], span=None, diagonal: bool = False) -> str:
    """Series as lines, in the order of their colours; those beyond the colours are gray."""
    every = [p for _, own in series for p in own] or [(0.0, 0.0)]
    xs, ys = span or ((min(p[0] for p in every), max(p[0] for p in every)), (min(p[1] for p in every), max(p[1] for p in every)))

    def body(px, py):
        if diagonal:
            yield f'<line class="a" x1="{px(0):.1f}" y1="{py(0):.1f}" x2="{px(1):.1f}" y2="{py(1):.1f}"/>'
        for k, (name, own) in enumerate(series, 1):
            path = " ".join(f"{px(a):.1f},{py(b):.1f}" for a, b in thin(own))
            yield f'<polyline class="l" stroke="{colour(k)}" points="{path}"><title>{esc(name)}</title></polyline>'
            for a, b in thin(own, 12):
                yield f'<circle cx="{px(a):.1f}" cy="{py(b):.1f}" r="8" fill="transparent"><title>{esc(name)}: {esc(a)}, {esc(b)}</title></circle>'

    return frame(title, x, y, xs, ys, body, [(n, k) for k, (n, _) in enumerate(series[:COLOURS], 1)])


def dots(title: str, x: str, y: str, series: Sequence[tuple[str, list[tuple[float, float]]]], span=None, diagonal: bool = False) -> str:
    every = [p for _, own in series for p in own] or [(0.0, 0.0)]
    room = lambda v: (min(v) - 0.05 * (max(v) - min(v)), max(v) + 0.05 * (max(v) - min(v)))
    xs, ys = span or (room([p[0] for p in every]), room([p[1] for p in every]))

    def body(px, py):
        if diagonal:
            yield f'<line class="a" x1="{px(0):.1f}" y1="{py(0):.1f}" x2="{px(1):.1f}" y2="{py(1):.1f}"/>'
        for k, (name, own) in enumerate(series, 1):
            for a, b in own:
                yield mark(px(a), py(b), k, f"{name}: {a:.4g}, {b:.4g}")

    return frame(title, x, y, xs, ys, body, [(n, k) for k, (n, _) in enumerate(series[:COLOURS], 1)])


def rows(title: str, x: str, items: Sequence[tuple[str, float, float | None, float | None]], span=None) -> str:
    """Names down the side, each with a bar to its value, or a dot between two ends."""
    values = [v for _, *own in items for v in own if v is not None] or [0.0]
    xs = span or (min(0.0, *values), max(0.0, *values))
    n = len(items)

    def body(px, py):
        for k, (name, value, low, high) in enumerate(items):
            y = py(n - 1 - k)
            if low is None:
                a, b = sorted((px(max(0.0, xs[0])), px(value)))
                yield f'<path d="M{a:.1f} {y - 5:.1f}H{max(a, b - 4):.1f}q4 0 4 4v2q0 4 -4 4H{a:.1f}z" fill="{colour(1)}"><title>{esc(name)}: {esc(value)}</title></path>'
            else:
                yield f'<line class="l" stroke="{colour(1)}" x1="{px(low):.1f}" x2="{px(high):.1f}" y1="{y:.1f}" y2="{y:.1f}"/>' + mark(px(value), y, 1, f"{name}: {value:.4g} ({low:.4g} to {high:.4g})")

    wide = min(220, 24 + 7 * max((len(str(i[0])) for i in items), default=0))
    return frame(title, x, "", xs, (-0.5, max(n - 0.5, 0.5)), body, height=TOP + BOTTOM + 18 * max(n, 1), left=max(LEFT, wide), names=[i[0] for i in items])


def pictures(tables: dict[str, list], outcome_names: Sequence[str] = ()) -> dict[str, str]:
    """Name -> SVG of the figures among tables (name -> rows)."""
    out, of = {}, lambda n: tables.get(n) or []
    label = lambda r: str(r["feature_id"])[:28] + (f" ({r['contrast']})" if r["contrast"] else "")
    named = lambda c: outcome_names[c] if c < len(outcome_names) else str(c)
    unit = ((0.0, 1.0), (0.0, 1.0))
    if top := sorted(of("selection_frequency"), key=lambda r: r["evidence_rank"]):
        out["selection_frequency"] = rows("Selection frequency over resamples", "share of resamples", [(label(r), r["selection_frequency"], None, None) for r in top], (0.0, 1.0))
    if top := sorted(of("coefficient_spread"), key=lambda r: r["evidence_rank"]):
        out["coefficient_spread"] = rows("Coefficients over resamples", "median and quartiles", [(label(r), r["coefficient_median"], r["coefficient_q25"], r["coefficient_q75"]) for r in top])
    if curves := of("curves"):
        own = {c: sorted((r for r in curves if r["class"] == c), key=lambda r: -r["p"]) for c in sorted({r["class"] for r in curves})}
        roc, pr = [], []
        for c, steps in own.items():
            t, f = (sum(r[k] for r in steps) or 1.0 for k in ("tp", "fp"))
            roc.append((named(c), [(0.0, 0.0), *((r["cum_fp"] / f, r["cum_tp"] / t) for r in steps)]))
            pr.append((named(c), [(r["cum_tp"] / t, r["cum_tp"] / (r["cum_tp"] + r["cum_fp"])) for r in steps if r["cum_tp"] + r["cum_fp"] > 0]))
        out["roc"] = lines("Held-out ROC" + (f" of {roc[0][0]}" if len(roc) == 1 else ", each class against the rest"), "false positive share", "true positive share", roc, unit, True)
        out["precision_recall"] = lines("Held-out precision and recall", "recall", "precision", pr, unit)
    if bins := of("calibration"):
        series = [(named(c), [(r["mean_probability"], r["observed_fraction"]) for r in bins if r["class"] == c]) for c in sorted({r["class"] for r in bins})]
        out["calibration"] = dots("Calibration of held-out probabilities", "mean probability", "observed share", series, unit, True)
    if points := of("scatter"):
        out["scatter"] = dots("Held-out predictions", "response", "prediction", [("samples", [(r["y"], r["p"]) for r in points])])
    if points := of("principal_components"):
        series = [(o, [(r["pc1"], r["pc2"]) for r in points if r["outcome"] == o]) for o in sorted({r["outcome"] for r in points})]
        series = series if len(series) <= COLOURS else [("samples", [(r["pc1"], r["pc2"]) for r in points])]  # a response
        out["principal_components"] = dots("Principal components (descriptive)", "first component", "second component", series)
    if coefs := of("path"):
        own: dict[tuple, list] = {}
        for r in coefs:
            own.setdefault((r["feature"], r["contrast"]), []).append((math.log10(r["strength"]), r["coef"]))
        ordered = sorted(own.items(), key=lambda kv: -max(abs(c) for _, c in kv[1]))
        out["path"] = lines("Coefficients by strength of the penalty", "log10 strength", "coefficient", [(f"feature {f}" + (f" ({c})" if c else ""), sorted(v)) for (f, c), v in ordered])
    if null := [r for r in of("permutations") if r["improvement"] is not None]:
        series = [(n, [(r["improvement"], float(r["perm_id"])) for r in null if (r["perm_id"] == 0) == seen]) for n, seen in (("observed", True), ("permuted", False))]
        out["permutations"] = dots("Improvement over the baseline", "improvement of held-out loss", "permutation", series)
    return out
