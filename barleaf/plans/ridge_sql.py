"""Standardised ridge fits as DuckDB text: product sums, then elimination by one pivot per step."""

from __future__ import annotations

from collections.abc import Sequence


def ridge_ctes(name: str, source: str, by: Sequence[str], features: Sequence[str], targets: Sequence[str], ridge: float = 1.0, least: int = 100) -> list[str]:
    """CTEs that end in ``name``: by, n, mean (list), and for target t ``a_t`` and ``b_t`` (list).

    ``source`` must hold no nulls in the inputs and targets.
    """
    k, keys = len(features), ", ".join(by)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [f"sum({f}) as s{i}" for i, f in enumerate(features)] + [f"sum({features[i]} * {features[j]}) as p{i}_{j}" for i, j in pairs]
    for t, y in enumerate(targets):
        sums += [f"sum({y}) as t{t}"] + [f"sum({f} * {y}) as q{i}_{t}" for i, f in enumerate(features)]
    out = [f"{name}_m as materialized (select {keys}, cast(count(*) as double) as n, {', '.join(sums)} from {source} group by {keys} having count(*) >= {least})"]
    sds = ", ".join(f"sqrt(greatest(p{i}_{i} / n - (s{i} / n) * (s{i} / n), 1e-24)) as d{i}" for i in range(k))
    out.append(f"{name}_s as materialized (select *, {sds} from {name}_m)")

    def row(i: int) -> str:
        left = [f"(p{min(i, j)}_{max(i, j)} / n - (s{i} / n) * (s{j} / n)) / (d{i} * d{j})" + (f" + {ridge!r} / n" if i == j else "") for j in range(k)]
        right = [f"(q{i}_{t} / n - (s{i} / n) * (t{t} / n)) / d{i}" for t in range(len(targets))]
        return f"select {keys}, {i + 1} as i, [{', '.join(left + right)}] as r from {name}_s"

    out.append(f"{name}_0 as materialized (" + " union all ".join(row(i) for i in range(k)) + ")")
    for p in range(1, k + 1):
        step = f"case when a.i = {p} then list_transform(a.r, lambda x: x / a.r[{p}]) else list_transform(a.r, lambda x, c: x - a.r[{p}] / b.r[{p}] * b.r[c]) end"
        out.append(f"{name}_{p} as materialized (select {', '.join(f'a.{c}' for c in by)}, a.i, {step} as r from {name}_{p - 1} a join {name}_{p - 1} b on {' and '.join(f'a.{c} = b.{c}' for c in by)} and b.i = {p})")
    out.append(f"{name}_g as materialized (select {keys}, list(r order by i) as r from {name}_{k} group by {keys})")
    betas = [f"[{', '.join(f'r[{i + 1}][{k + t + 1}] / d{i}' for i in range(k))}]" for t in range(len(targets))]
    cols = [f"{b} as b_{t}" for t, b in enumerate(betas)]
    cols += [f"t{t} / n - (" + " + ".join(f"r[{i + 1}][{k + t + 1}] / d{i} * (s{i} / n)" for i in range(k)) + f") as a_{t}" for t in range(len(targets))]
    out.append(f"{name} as materialized (select {keys}, n, [{', '.join(f's{i} / n' for i in range(k))}] as mean, {', '.join(cols)} from {name}_s join {name}_g using ({keys}))")
    return out


def score_sql(features: Sequence[str], t: int = 0) -> str:
    return f"a_{t} + " + " + ".join(f"{f} * b_{t}[{i + 1}]" for i, f in enumerate(features))


def quantile_ctes(name: str, source: str, by: str, features: Sequence[str], quantiles: Sequence[float], steps: int, shrink: float, narrowest: float) -> list[str]:
    """CTEs that end in ``name``: by, q, b (list, constant first), with ``{name}_st`` holding the means and spreads.

    Every step is written out: a weighted sum of products, then elimination by one pivot per CTE.
    """
    k = len(features) + 1
    stats = ", ".join(f"avg({f}) as m{i}, greatest(stddev_pop({f}), 1e-12) as d{i}" for i, f in enumerate(features))
    unit = ", ".join(["cast(1 as double)", *[f"({f} - m{i}) / d{i}" for i, f in enumerate(features)]])
    out = [
        f"{name}_st as materialized (select {by}, cast(count(*) as double) as n, {stats} from {source} group by {by})",
        f"{name}_u as materialized (select {by}, cast(y as double) as y, {', '.join(f'x[{i + 1}] as u{i}' for i in range(k))} from (select {by}, y, [{unit}] as x from {source} join {name}_st using ({by})))",
    ]
    fit = " + ".join(f"u{i} * b[{i + 1}]" for i in range(k))

    def solved(step: str, rows: str, keys: str) -> None:
        gram = [f"sum(w * u{i} * u{j}) as g{i}_{j}" for i in range(k) for j in range(i, k)] + [f"sum(w * u{i} * y) as h{i}" for i in range(k)]
        out.append(f"{step}_m as materialized (select {keys}, {', '.join(gram)} from ({rows}) group by {keys})")
        line = lambda i: ", ".join([f"g{min(i, j)}_{max(i, j)}" + (" + 1e-9 * g0_0" if i == j else "") for j in range(k)] + [f"h{i}"])
        out.append(f"{step}_0 as materialized (" + " union all ".join(f"select {keys}, {i + 1} as i, [{line(i)}] as r from {step}_m" for i in range(k)) + ")")
        same = " and ".join(f"a.{c} = b.{c}" for c in keys.split(", "))
        for p in range(1, k + 1):
            move = f"case when a.i = {p} then list_transform(a.r, lambda x: x / a.r[{p}]) else list_transform(a.r, lambda x, c: x - a.r[{p}] / b.r[{p}] * b.r[c]) end"
            out.append(f"{step}_{p} as materialized (select {', '.join('a.' + c for c in keys.split(', '))}, a.i, {move} as r from {step}_{p - 1} a join {step}_{p - 1} b on {same} and b.i = {p})")
        out.append(f"{step} as materialized (select {keys}, list(r[{k + 1}] order by i) as b from {step}_{k} group by {keys})")

    solved(f"{name}_p", f"select *, cast(1 as double) as w from {name}_u", by)
    out.append(f"{name}_sc as materialized (select {by}, avg(abs(y - ({fit}))) as s from {name}_u join {name}_p using ({by}) group by {by})")
    out.append(f"{name}_i0 as materialized (select {by}, q, b from {name}_p, (select unnest([{', '.join(f'cast({q!r} as double)' for q in quantiles)}]) as q))")
    for t in range(steps):
        width = max(shrink**t, narrowest)
        rows = f"select *, case when e > 0 then q else 1 - q end / greatest(abs(e), s * cast({width!r} as double)) as w from (select u.*, q, s, y - ({fit}) as e from {name}_u u join {name}_i{t} using ({by}) join {name}_sc using ({by}))"
        solved(f"{name}_i{t + 1}", rows, f"{by}, q")
    out.append(f"{name} as materialized (select * from {name}_i{steps})")
    return out


def quantile_sql(features: Sequence[str]) -> str:
    return "b[1] + " + " + ".join(f"b[{i + 2}] * ({f} - m{i}) / d{i}" for i, f in enumerate(features))
