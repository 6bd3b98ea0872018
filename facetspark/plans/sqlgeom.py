"""Vector formulas as SQL text, for the statements that results are held against."""

from __future__ import annotations

V = tuple[str, str, str]


def vec(*names: str) -> V:
    return tuple(str(n) for n in names)  # type: ignore[return-value]


def lit(*values: float) -> V:
    return tuple(f"CAST({v!r} AS DOUBLE)" for v in map(float, values))  # type: ignore[return-value]


def dot(a: V, b: V) -> str:
    return "(" + " + ".join(f"({x})*({y})" for x, y in zip(a, b, strict=True)) + ")"


def cross(a: V, b: V) -> V:
    def minor(i: int, j: int) -> str:
        return f"(({a[i]})*({b[j]}) - ({a[j]})*({b[i]}))"

    return minor(1, 2), minor(2, 0), minor(0, 1)


def add(a: V, b: V) -> V:
    return tuple(f"(({x}) + ({y}))" for x, y in zip(a, b, strict=True))  # type: ignore[return-value]


def sub(a: V, b: V) -> V:
    return tuple(f"(({x}) - ({y}))" for x, y in zip(a, b, strict=True))  # type: ignore[return-value]


def mul(a: V, k: str) -> V:
    return tuple(f"(({x})*({k}))" for x in a)  # type: ignore[return-value]


def norm(a: V) -> str:
    return f"sqrt({dot(a, a)})"


def sign(a: V) -> str:
    x, y, z = a
    return (
        f"(CASE WHEN (CASE WHEN abs({x}) >= abs({y}) AND abs({x}) >= abs({z}) THEN {x} WHEN abs({y}) >= abs({z}) THEN {y} ELSE {z} END) < 0"
        " THEN CAST(-1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END)"
    )


def out(expr: str, name: str, digits: int = 6) -> str:
    """A rounded double without negative zeros."""
    return f"round({expr}, {digits}) + CAST(0 AS DOUBLE) AS {name}"


def basis(n: tuple[float, float, float]) -> tuple[list[float], list[float]]:
    """Literal (u, v) across a literal unit normal."""
    a = (0.0, 1.0, 0.0) if abs(n[0]) > 0.9 else (1.0, 0.0, 0.0)
    u = [n[1] * a[2] - n[2] * a[1], n[2] * a[0] - n[0] * a[2], n[0] * a[1] - n[1] * a[0]]
    k = sum(c * c for c in u) ** 0.5
    u = [c / k for c in u]
    v = [n[1] * u[2] - n[2] * u[1], n[2] * u[0] - n[0] * u[2], n[0] * u[1] - n[1] * u[0]]
    return u, v


def eigen(source: str, key: str, name: str, largest: bool = False) -> str:
    """CTEs ending in ``name``(key, n, mx, my, mz, vx, vy, vz): an eigenvector of a moments CTE in closed form.

    The eigenvalue comes from the cubic's trigonometric solution, the vector from the
    longest cross product of two rows of A - value I.
    """
    turn = "0" if largest else "2 * pi() / 3"
    a = name
    r0, r1, r2 = vec("cxx - w", "cxy", "cxz"), vec("cxy", "cyy - w", "cyz"), vec("cxz", "cyz", "czz - w")
    c0, c1, c2 = cross(r0, r1), cross(r0, r2), cross(r1, r2)
    names = [vec(*(f"{p}{k}" for k in "xyz")) for p in ("p", "q", "s")]
    pick = ", ".join(
        f"CASE WHEN l0 >= l1 AND l0 >= l2 THEN p{k} / sqrt(l0) WHEN l1 >= l2 THEN q{k} / sqrt(l1) ELSE s{k} / sqrt(l2) END AS e{k}" for k in "xyz"
    )
    crosses = ", ".join(f"{e} AS {n}" for c, ns in zip((c0, c1, c2), names, strict=True) for e, n in zip(c, ns, strict=True))
    e = vec("ex", "ey", "ez")
    return f"""
{a}_q AS (SELECT *, (cxx + cyy + czz) / 3 AS qq, cxy*cxy + cxz*cxz + cyz*cyz AS p1 FROM {source}),
{a}_p AS (SELECT *, sqrt(((cxx-qq)*(cxx-qq) + (cyy-qq)*(cyy-qq) + (czz-qq)*(czz-qq) + 2*p1) / 6) AS pp FROM {a}_q),
{a}_r AS (SELECT *, ((cxx-qq)*((cyy-qq)*(czz-qq) - cyz*cyz) - cxy*(cxy*(czz-qq) - cyz*cxz) + cxz*(cxy*cyz - (cyy-qq)*cxz)) / (2*pp*pp*pp) AS rr FROM {a}_p),
{a}_w AS (SELECT *, qq + 2 * pp * cos(acos(greatest(-1.0, least(1.0, rr))) / 3 + {turn}) AS w FROM {a}_r),
{a}_c AS (SELECT *, {crosses} FROM {a}_w),
{a}_l AS (SELECT *, {dot(names[0], names[0])} AS l0, {dot(names[1], names[1])} AS l1, {dot(names[2], names[2])} AS l2 FROM {a}_c),
{a}_e AS (SELECT *, {pick} FROM {a}_l),
{name} AS (SELECT {key}, n, mx, my, mz, ex * {sign(e)} AS vx, ey * {sign(e)} AS vy, ez * {sign(e)} AS vz FROM {a}_e)"""


MOMENTS = (
    "count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS cxx, covar_pop(y, y) AS cyy, covar_pop(z, z) AS czz,"
    " covar_pop(x, y) AS cxy, covar_pop(x, z) AS cxz, covar_pop(y, z) AS cyz"
)
