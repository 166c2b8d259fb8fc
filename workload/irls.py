"""Logistic fits in plain SQL: Newton steps in a recursive CTE, independent of Spark ML."""

from __future__ import annotations

STEPS = 15


def irls(name: str, train: str, features: list[str], label: str = "y") -> str:
    """CTE body: (step, b0, b1, ...) from the rows of ``train``. Each step solves the normal equations by
    elimination, written out column by column."""
    k = len(features) + 1
    x = ["1e0", *features]
    b = [f"b{i}" for i in range(k)]
    eta = " + ".join(f"i.{b[j]} * t.{x[j]}" if j else "i.b0" for j in range(k))
    h = {(i, j): f"h{i}{j}" for i in range(k) for j in range(i, k)}
    rows = (
        f"select i.step, {', '.join('i.' + c for c in b)}, "
        + "".join(f"t.{f}, " for f in features)
        + f"t.{label} y, 1e0 / (1e0 + exp(-({eta}))) p from {{{name}}} i, {{{train}}} t where i.step < {STEPS}"
    )
    sums = [f"sum(p * (1e0 - p) * {x[i]} * {x[j]}) {h[i, j]}" for i, j in h]
    sums += [f"sum((y - p) * {x[i]}) g{i}" for i in range(k)]
    sql = f"select step, {', '.join(b)}, {', '.join(sums)} from ({rows}) r group by step, {', '.join(b)}"
    for m in range(k - 1):
        left = [(i, j) for i, j in h if i > m]
        new = [f"{h[i, j]} - {h[m, i]} * {h[m, j]} / {h[m, m]} {h[i, j]}" for i, j in left]
        new += [f"g{i} - {h[m, i]} * g{m} / {h[m, m]} g{i}" for i in range(m + 1, k)]
        keep = ["step", *b, *[h[i, j] for i, j in h if i <= m], *[f"g{i}" for i in range(m + 1)]]
        sql = f"select {', '.join(keep + new)} from ({sql}) e{m}"
    for m in reversed(range(k)):
        rest = "".join(f" - {h[m, j]} * d{j}" for j in range(m + 1, k))
        sql = f"select *, (g{m}{rest}) / {h[m, m]} d{m} from ({sql}) s{m}"
    start = ", ".join(f"0e0 {c}" for c in b)
    step = ", ".join(f"{c} + d{i}" for i, c in enumerate(b))
    return f"select 0 step, {start} union all select step + 1, {step} from ({sql}) z"


FIRTH_STEPS = 60


def firth_two(name: str, train: str, a: str, b: str, label: str = "y") -> str:
    """CTE body: (step, b0, b1, b2), the fit with Jeffreys' prior on two features. The information's inverse is written
    out by cofactors, and the prior's gradient comes from third moments."""
    x = ["1e0", f"t.{a}", f"t.{b}"]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    triples = [(i, j, k) for i, j in pairs for k in range(j, 3)]
    sums = [f"sum((y - p) * x{i}) g{i}" for i in range(3)]
    sums += [f"sum(p * (1e0 - p) * x{i} * x{j}) h{i}{j}" for i, j in pairs]
    sums += [f"sum(p * (1e0 - p) * (0.5e0 - p) * x{i} * x{j} * x{k}) t{i}{j}{k}" for i, j, k in triples]

    def h(i: int, j: int) -> str:
        return f"h{min(i, j)}{max(i, j)}"

    def cofactor(i: int, j: int) -> str:
        r, c = [m for m in range(3) if m != i], [m for m in range(3) if m != j]
        return f"{'-' if (i + j) % 2 else ''}({h(r[0], c[0])} * {h(r[1], c[1])} - {h(r[0], c[1])} * {h(r[1], c[0])})"

    inverse = {(i, j): f"c{i}{j} / det" for i, j in pairs}
    prior = [
        " + ".join(f"{'' if i == j else '2e0 * '}c{i}{j} / det * t{''.join(map(str, sorted((i, j, k))))}" for i, j in pairs) for k in range(3)
    ]
    steps = [" + ".join(f"{inverse[min(i, j), max(i, j)]} * u{j}" for j in range(3)) for i in range(3)]
    rows = (
        f"select i.step, i.b0, i.b1, i.b2, {', '.join(f'{v} x{i}' for i, v in enumerate(x))}, t.{label} y, "
        f"1e0 / (1e0 + exp(-(i.b0 + i.b1 * {x[1]} + i.b2 * {x[2]}))) p from {{{name}}} i, {{{train}}} t where i.step < {FIRTH_STEPS}"
    )
    summed = f"select step, b0, b1, b2, {', '.join(sums)} from ({rows}) r group by step, b0, b1, b2"
    inverted = f"select *, {', '.join(f'{cofactor(i, j)} c{i}{j}' for i, j in pairs)} from ({summed}) s"
    scaled = f"select *, h00 * c00 + h01 * c01 + h02 * c02 det from ({inverted}) v"
    pulled = f"select *, {', '.join(f'g{k} + {prior[k]} u{k}' for k in range(3))} from ({scaled}) w"
    moved = f"select *, {', '.join(f'{steps[k]} d{k}' for k in range(3))} from ({pulled}) m"
    short = f"select *, least(1e0, greatest(5e0, abs(b0), abs(b1), abs(b2)) / greatest(abs(d0), abs(d1), abs(d2), 1e-300)) f from ({moved}) n"
    return f"select 0 step, 0e0 b0, 0e0 b1, 0e0 b2 union all select step + 1, b0 + f * d0, b1 + f * d1, b2 + f * d2 from ({short}) z"


def last_step(name: str) -> str:
    return f"(select * from {{{name}}} where step = {STEPS})"


def terms(name: str, model: str, features: list[str], digits: int) -> str:
    """(model, term, estimate) rows of a finished fit."""
    picks = ["(Intercept)", *features]
    return "\nunion all\n".join(
        f"select '{model}' model, '{t}' term, round(b{i}, {digits}) estimate from {last_step(name)} f"
        for i, t in enumerate(picks)
    )
