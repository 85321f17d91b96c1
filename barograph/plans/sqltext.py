"""Pieces of SQL for the twins: common tables and frame helpers."""

from __future__ import annotations

BARS = """bars AS (
 SELECT series_id, t, arg_min(p, seq) AS open, max(p) AS high, min(p) AS low,
        arg_max(p, seq) AS close, sum(v) AS volume
 FROM (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS t,
              (l_orderkey * 8 + l_linenumber) * 65536 + (CAST(round(l_extendedprice * 100) AS BIGINT) * 50 + CAST(l_quantity AS BIGINT)) % 65536 AS seq,
              l_extendedprice / l_quantity AS p, l_quantity AS v FROM lineitem)
 GROUP BY series_id, t)"""

RET = """r AS (
 SELECT *, row_number() OVER w AS pos, close / lag(close) OVER w - 1 AS simple_return,
        ln(close / lag(close) OVER w) AS log_return,
        pow(ln(close / lag(close) OVER w), 2) * 252 AS rv
 FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY t))"""

W = "(PARTITION BY series_id ORDER BY t)"


def lag(x: str, k: int = 1, part: str = "series_id") -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY {part} ORDER BY t)"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) OVER {W}"


def frame(size: int, skip: int = 0, part: str = "series_id", order: str = "t") -> str:
    return (
        f"(PARTITION BY {part} ORDER BY {order} "
        f"ROWS BETWEEN {size - 1 + skip} PRECEDING AND {skip} PRECEDING)"
    )


def roll(agg: str, x: str, size: int, min_rows: int | None = None, skip: int = 0,
         part: str = "series_id") -> str:
    f = frame(size, skip, part)
    return f"(CASE WHEN count({x}) OVER {f} >= {min_rows or size} THEN {agg}({x}) OVER {f} END)"


def roll2(agg: str, x: str, y: str, size: int, min_rows: int | None = None, skip: int = 0,
          part: str = "series_id") -> str:
    f = frame(size, skip, part)
    xs = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {x} END"
    ys = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {y} END"
    return (
        f"(CASE WHEN count({xs}) OVER {f} >= {min_rows or size} THEN {agg}({xs}, {ys}) OVER {f} END)"
    )


def decayed(src: str, out: str, x: str, lam: float, reach: int, keys: str = "series_id",
            pos: str = "pos") -> str:
    """Table ``out(keys, t, v)``: direct decayed sum over the last ``reach`` rows."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"a.{k} = b.{k}" for k in ks)
    sel = ", ".join(f"a.{k}" for k in ks)
    return (
        f"{out} AS (SELECT {sel}, a.t, sum(pow({lam}, a.{pos} - b.{pos}) * b.{x}) AS v "
        f"FROM {src} a JOIN {src} b ON {on} AND b.{pos} BETWEEN a.{pos} - {reach} AND a.{pos} "
        f"GROUP BY {sel}, a.t)"
    )


def ewm(src: str, out: str, x: str, span: int, min_rows: int) -> str:
    """Table ``out(series_id, t, v)``: weighted mean written as a direct sum."""
    keep = 1.0 - 2.0 / (span + 1.0)
    reach = int(40.0 / -__import__("math").log(keep)) + 1
    wt = f"pow({keep!r}, a.pos - b.pos)"
    return (
        f"{out} AS (SELECT a.series_id, a.t, CASE WHEN max(a.seen) >= {min_rows} THEN "
        f"sum({wt} * b.{x}) / sum(CASE WHEN b.{x} IS NOT NULL THEN {wt} END) END AS v "
        f"FROM (SELECT *, count({x}) OVER {frame(100000)} AS seen FROM {src}) a "
        f"JOIN {src} b ON a.series_id = b.series_id AND b.pos BETWEEN a.pos - {reach} AND a.pos "
        f"GROUP BY a.series_id, a.t)"
    )


def skew(x: str, f: str | None = None) -> str:
    """DuckDB's skewness is already bias-corrected."""
    return f"skewness({x})" + (f" OVER {f}" if f else "")


def kurt(x: str, f: str | None = None) -> str:
    return f"kurtosis({x})" + (f" OVER {f}" if f else "")


def solve(src: str, keys: str, k: int, out: str = "sol") -> list[str]:
    """Gauss-Jordan on columns ``a{i}_{j}`` (j = k is the right side): ``out(keys, x0..)``."""
    steps, prev = [], src
    for p in range(k):
        cells = []
        for i in range(k):
            for j in range(p + 1, k + 1):
                if i == p:
                    cells.append(f"a{p}_{j} / a{p}_{p} AS a{i}_{j}")
                else:
                    cells.append(f"a{i}_{j} - a{i}_{p} * a{p}_{j} / a{p}_{p} AS a{i}_{j}")
        name = f"{out}_s{p}"
        steps.append(f"{name} AS (SELECT {keys}, n, {', '.join(cells)} FROM {prev})")
        prev = name
    xs = ", ".join(f"a{i}_{k} AS x{i}" for i in range(k))
    steps.append(f"{out} AS (SELECT {keys}, n, {xs} FROM {prev})")
    return steps


def ridge(src: str, keys: str, xs: list[str], y: str, alpha: float, scaled: bool,
          out: str = "fit", where: str = "TRUE") -> list[str]:
    """Tables ending in ``out(keys, n, w0.., b0.., c, rss, tss)`` for y on xs with intercept."""
    k = len(xs)
    m = ", ".join(
        [f"avg({x}) AS m{i}" for i, x in enumerate(xs)]
        + [
            f"CASE WHEN stddev_pop({x}) > 0 THEN stddev_pop({x}) ELSE 1.0 END AS d{i}"
            if scaled else f"1.0 AS d{i}"
            for i, x in enumerate(xs)
        ]
        + [f"avg({y}) AS my", "count(*) AS n"]
    )
    using = f"USING ({keys})" if keys else ""
    moms = f"{out}_m AS (SELECT {keys}, {m} FROM {src} WHERE {where} GROUP BY {keys})"
    z = ", ".join([f"(s.{x} - q.m{i}) / q.d{i} AS z{i}" for i, x in enumerate(xs)])
    zed = (
        f"{out}_z AS (SELECT {keys}, q.n, {z}, s.{y} - q.my AS zy "
        f"FROM (SELECT * FROM {src} WHERE {where}) s JOIN {out}_m q {using})"
    )
    cells = []
    for i in range(k):
        for j in range(k):
            extra = f" + {alpha}" if i == j and alpha else ""
            cells.append(f"sum(z{i} * z{j}){extra} AS a{i}_{j}")
        cells.append(f"sum(z{i} * zy) AS a{i}_{k}")
    sums = f"{out}_a AS (SELECT {keys}, max(n) AS n, {', '.join(cells)} FROM {out}_z GROUP BY {keys})"
    steps = [moms, zed, sums, *solve(f"{out}_a", keys, k, f"{out}_x")]
    fitted = " + ".join(f"x{i} * z{i}" for i in range(k))
    steps.append(
        f"{out}_e AS (SELECT {keys}, sum(pow(zy - ({fitted}), 2)) AS rss, sum(zy * zy) AS tss "
        f"FROM {out}_z JOIN {out}_x {using} GROUP BY {keys})"
    )
    beta = ", ".join(
        [f"x{i} AS w{i}" for i in range(k)] + [f"x{i} / d{i} AS b{i}" for i in range(k)]
    )
    icpt = " - ".join(["my", *[f"x{i} / d{i} * m{i}" for i in range(k)]])
    steps.append(
        f"{out} AS (SELECT {keys}, {out}_m.n, {beta}, {icpt} AS c, rss, tss "
        f"FROM {out}_m JOIN {out}_x {using} JOIN {out}_e {using})"
    )
    return steps


def erf(x: str) -> str:
    u = f"abs({x})"
    k = f"(1.0 / (1.0 + CAST(0.3275911 AS DOUBLE) * {u}))"
    poly = f"({k} * (0.254829592 + {k} * (-0.284496736 + {k} * (1.421413741 + {k} * (-1.453152027 + {k} * 1.061405429)))))"
    return f"(sign({x}) * (1.0 - {poly} * exp(-{u} * {u})))"


def chi2_1(x: str) -> str:
    return f"(1.0 - {erf(f'sqrt(greatest({x}, 0.0) / 2)')})"


def chi2_3(x: str) -> str:
    return (
        f"({chi2_1(x)} + sqrt(greatest({x}, 0.0) * 2.0 / pi()) * exp(-greatest({x}, 0.0) / 2))"
    )


def norm_tail2(x: str) -> str:
    return f"(1.0 - {erf(f'(abs({x}) / sqrt(2.0))')})"


def solved(src: str, on: list[int]) -> str:
    """``src`` with w<i> for i in ``on``: the solution of the equations g<i><j> w = c<i>, by Cholesky columns."""
    for n, j in enumerate(on):
        before = on[:n]
        d = f"g{j}{j}" + "".join(f" - l{j}{m} * l{j}{m}" for m in before)
        src = f"(SELECT *, sqrt(greatest({d}, 1e-300)) AS l{j}{j} FROM {src})"
        cells = [
            f"(g{j}{i}" + "".join(f" - l{i}{m} * l{j}{m}" for m in before) + f") / l{j}{j} AS l{i}{j}" for i in on[n + 1 :]
        ]
        cells.append(f"(c{j}" + "".join(f" - l{j}{m} * f{m}" for m in before) + f") / l{j}{j} AS f{j}")
        src = f"(SELECT *, {', '.join(cells)} FROM {src})"
    for n, j in reversed(list(enumerate(on))):
        w = f"(f{j}" + "".join(f" - l{m}{j} * w{m}" for m in on[n + 1 :]) + f") / l{j}{j} AS w{j}"
        src = f"(SELECT *, {w} FROM {src})"
    return src


def query(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
