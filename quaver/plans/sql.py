"""Pieces of SQL for the oracles, from formulas of their own: the engine's code and constants are not used here."""

from __future__ import annotations


def coefficients(kind: str, f: float, gain: float = 0.0, q: float = 0.707, fs: int = 48_000) -> tuple[str, ...]:
    w, a = f"(2 * pi() * {f!r} / {fs!r}::DOUBLE)", f"pow(10::DOUBLE, {gain!r} / 40::DOUBLE)"
    c, s = f"cos({w})", f"sin({w})"
    if kind in ("high", "low"):
        al, sign = f"({s} / (2 * {q!r}::DOUBLE))", "+" if kind == "high" else "-"
        a0 = f"(1 + {al})"
        mid = f"(-(1 + {c}) / {a0})" if kind == "high" else f"((1 - {c}) / {a0})"
        b = f"((1 {sign} {c}) / 2 / {a0})"
        return b, mid, b, f"(-2 * {c} / {a0})", f"((1 - {al}) / {a0})"
    if kind == "peak":
        al = f"({s} / (2 * {q!r}::DOUBLE))"
        a0 = f"(1 + {al} / {a})"
        return f"((1 + {al} * {a}) / {a0})", f"(-2 * {c} / {a0})", f"((1 - {al} * {a}) / {a0})", f"(-2 * {c} / {a0})", f"((1 - {al} / {a}) / {a0})"
    t = f"(2 * sqrt({a}) * ({s} / 2 * sqrt(({a} + 1 / {a}) * (1 / {q!r}::DOUBLE - 1) + 2)))"
    up, down = ("+", "-") if kind == "highshelf" else ("-", "+")
    a0 = f"(({a} + 1) {down} ({a} - 1) * {c} + {t})"
    two = "-2" if kind == "highshelf" else "2"
    return (
        f"({a} * (({a} + 1) {up} ({a} - 1) * {c} + {t}) / {a0})", f"({two} * {a} * (({a} - 1) {up} ({a} + 1) * {c}) / {a0})", f"({a} * (({a} + 1) {up} ({a} - 1) * {c} - {t}) / {a0})",
        f"({'2' if kind == 'highshelf' else '-2'} * (({a} - 1) {down} ({a} + 1) * {c}) / {a0})", f"((({a} + 1) {down} ({a} - 1) * {c} - {t}) / {a0})",
    )


def _constants(stages: list[tuple[str, ...]]) -> tuple[str, list[tuple[str, ...]]]:
    """A table of the filters' coefficients, and the names of its columns."""
    names = [[f"c{k}{n}" for n in ("b0", "b1", "b2", "a1", "a2")] for k in range(len(stages))]
    table = "SELECT " + ", ".join(f"{e} AS {n}" for st, ns in zip(stages, names, strict=True) for e, n in zip(st, ns, strict=True))
    return table, [tuple(f"coef.{n}" for n in ns) for ns in names]


def recursion(stages: list[tuple[str, ...]], channels="lr", signal: str = "") -> str:
    """f(track, i, y per channel) of a cascade given as SQL coefficients."""
    table, names = _constants(stages)
    cols, init, step = [], [], []
    for c in channels:
        x = x0 = f"s.{c}"
        for k, (b0, b1, b2, a1, a2) in enumerate(names):
            y, p, q = f"{c}y{k}", f"{c}p{k}", f"{c}q{k}"
            y0, y1 = f"({b0} * {x0})", f"({b0} * {x} + f.{p})"
            cols += [y, p, q]
            init += [f"{y0} AS {y}", f"({b1} * {x0} - {a1} * {y0}) AS {p}", f"({b2} * {x0} - {a2} * {y0}) AS {q}"]
            step += [y1, f"({b1} * {x} - {a1} * {y1} + f.{q})", f"({b2} * {x} - {a2} * {y1})"]
            x0, x = y0, y1
    last = len(names) - 1
    out = ", ".join(f"{c}y{last} AS f{c}" for c in channels)
    return f"""{signal}, coef AS MATERIALIZED ({table}), f AS (SELECT s.track, s.i, {', '.join(init)} FROM sp s, coef WHERE s.i = 0
  UNION ALL SELECT s.track, s.i, {', '.join(step)} FROM f JOIN sp s ON s.track = f.track AND s.i = f.i + 1, coef), fs AS (SELECT track, i, {out} FROM f)"""


def decay(seconds: float, fs: int = 4800) -> str:
    """What a one-pole smoother keeps from one sample to the next."""
    return f"exp(-1 / ({fs}::DOUBLE * {seconds!r}))"


def follow(name: str, x: str, up: float, down: float, fs: int = 4800) -> str:
    """One step of an envelope: up and down by their times."""
    return f"{name} + CASE WHEN {x} > {name} THEN 1 - {decay(up, fs)} ELSE 1 - {decay(down, fs)} END * ({x} - {name})"


def tap(fraction: float, n: int) -> str:
    k = n - (3 + fraction)
    return f"(sin(pi() * {k!r}) / (pi() * {k!r}) * greatest(0, 0.54 + 0.46 * cos(pi() * {k!r} / 4)))"


def between(c: str, fraction: float) -> str:
    """The signal a fraction of a sample further, over the window w."""
    total = " + ".join(tap(fraction, n) for n in range(8))
    return f"abs(({' + '.join(f'{tap(fraction, n)} * lag({c}, {n}, 0.0::DOUBLE) OVER w' for n in range(8))}) / ({total}))"
