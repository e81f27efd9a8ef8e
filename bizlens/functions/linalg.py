"""Small linear systems as SQL expressions: one row of sums in, coefficients out."""

from __future__ import annotations

from collections.abc import Sequence


def solve_sql(a: Sequence[Sequence[str]], b: Sequence[str], out: Sequence[str], *, tag: str = "_s",
              tiny: float = 1e-10) -> list[tuple[str, str]]:
    """(name, SQL expression) steps that solve the symmetric system ``a x = b``
    (``a`` by its lower triangle) by LDL factors; each step may use those before it.

    A pivot below ``tiny`` of its diagonal entry is a regressor that the others
    explain: its coefficient is 0, so singular systems have a defined result."""
    n, steps = len(b), []

    def minus(first: str, rest: list[str]) -> str:
        return "(" + first + "".join(f" - {r}" for r in rest) + ")"

    for j in range(n):
        d = f"{tag}d{j}"
        steps.append((d, minus(a[j][j], [f"{tag}l{j}{k} * {tag}l{j}{k} * {tag}d{k}" for k in range(j)])))
        ok = f"{d} > {tiny!r} * {a[j][j]}"
        for i in range(j + 1, n):
            top = minus(a[i][j], [f"{tag}l{i}{k} * {tag}l{j}{k} * {tag}d{k}" for k in range(j)])
            steps.append((f"{tag}l{i}{j}", f"CASE WHEN {ok} THEN {top} / {d} ELSE 0.0 END"))
    for j in range(n):
        steps.append((f"{tag}y{j}", minus(b[j], [f"{tag}l{j}{k} * {tag}y{k}" for k in range(j)])))
    for j in reversed(range(n)):
        ok = f"{tag}d{j} > {tiny!r} * {a[j][j]}"
        own = f"CASE WHEN {ok} THEN {tag}y{j} / {tag}d{j} ELSE 0.0 END"
        after = minus(own, [f"{tag}l{k}{j} * {out[k]}" for k in range(j + 1, n)])
        steps.append((out[j], f"CASE WHEN {ok} THEN {after} ELSE 0.0 END"))
    return steps


def products_sql(x: Sequence[str], y: str, *, tag: str) -> list[tuple[str, str]]:
    """(name, aggregate) of all sums of products that a regression of ``y`` on ``x`` needs."""
    out = [(f"{tag}{i}{j}", f"sum({x[i]} * {x[j]})") for i in range(len(x)) for j in range(i + 1)]
    return out + [(f"{tag}{i}y", f"sum({x[i]} * {y})") for i in range(len(x))]


def normal_sql(n: int, out: Sequence[str], *, tag: str) -> list[tuple[str, str]]:
    """The solving steps over the columns of :func:`products_sql`."""
    a = [[f"{tag}{i}{j}" for j in range(i + 1)] for i in range(n)]
    return solve_sql(a, [f"{tag}{i}y" for i in range(n)], out, tag=f"{tag}_")
