"""SQL pieces that say for another engine what `views` and the operators say here. Constants are doubles throughout."""

from __future__ import annotations

from .views import BANDS, COEFFICIENTS, SAMPLES


def r(x: str, name: str) -> str:
    return f"round({x}, 6) + 0e0 AS {name}"


def _flux(i: int) -> str:
    return f"CAST(embedding[{i + 1}] AS DOUBLE)"


_PHOT = ", ".join(f"{_flux(i)} AS f_{b}" for i, b in enumerate(BANDS)) + ", " + ", ".join(f"1e-2 + 5e-2 * abs({_flux(i)}) AS e_{b}" for i, b in enumerate(BANDS))
TARGETS = f"targets AS (SELECT vec_id AS target_id, {_PHOT}, CAST(vec_id % 7 AS DOUBLE) / 1e2 AS ebv, " + ", ".join(f"CAST((vec_id + {i}) % 9 - 4 AS DOUBLE) / 1e1 AS s_{b}" for i, b in enumerate(BANDS[:4])) + " FROM embeddings WHERE vec_id % 5 = 0)"
REFS = (
    f"refs AS (SELECT vec_id AS ref_id, {_PHOT}, CAST(label AS DOUBLE) AS z, 1e0 + vec_id % 3 AS weight, "
    + ", ".join(f"{1 + 0.25 * i}e0 + CAST(vec_id % 3 AS DOUBLE) / 1e1 AS ebv_{b}" for i, b in enumerate(BANDS))
    + ", CAST(vec_id % 4 AS DOUBLE) / 1e2 AS c0, CAST(vec_id % 6 - 2 AS DOUBLE) / 1e2 AS c1 FROM embeddings WHERE vec_id % 5 <> 0)"
)
BASE = f"WITH RECURSIVE {TARGETS}, {REFS}"


def euclidean(scale: str = "", n: str = "r.f_") -> str:
    s = f"{scale} * " if scale else ""
    return "sqrt(" + " + ".join(f"({s}{n}{b} - t.f_{b}) * ({s}{n}{b} - t.f_{b})" for b in BANDS) + ")"


def chi2(scale: str = "", n: str = "r.f_", e: str = "r.e_") -> str:
    s = f"{scale} * " if scale else ""
    return " + ".join(f"({s}{n}{b} - t.f_{b}) * ({s}{n}{b} - t.f_{b}) / (({s}{e}{b}) * ({s}{e}{b}) + t.e_{b} * t.e_{b})" for b in BANDS)


def knn(distance: str | None = None, k: int = 10, scale: str = "1e0", source: str = "targets t CROSS JOIN refs r") -> str:
    d = distance or chi2()
    return f"knn AS (SELECT * FROM (SELECT target_id, ref_id, distance, scale, row_number() OVER (PARTITION BY target_id ORDER BY distance, ref_id) AS rank FROM (SELECT t.target_id, r.ref_id, {d} AS distance, {scale} AS scale FROM {source})) WHERE rank <= {k})"


LONG = f"SELECT target_id, CAST(rank AS INT) AS rank, ref_id, {r('distance', 'distance')}, {r('scale', 'scale')} FROM knn"



def weighted(first: str = "exp(-5e-1 * {chi2})", second: str = "1e0 / {euclidean}", absolute: str = "1e0", errors: str = "r.e_") -> str:
    c, e = chi2(e=errors), euclidean()
    one, two = first.format(chi2=f"({c})", euclidean=e), second.format(chi2=f"({c})", euclidean=e)
    return (
        f"raw AS (SELECT k.target_id, k.ref_id, k.rank, k.scale, {one} AS w1, {two} AS w2, {absolute} AS wa, t.ebv, r.z, "
        + ", ".join(f"t.f_{b} AS f_{b}, t.e_{b} AS e_{b}, r.f_{b} AS n_f_{b}, r.e_{b} AS n_e_{b}" for b in BANDS)
        + " FROM knn k JOIN targets t ON t.target_id = k.target_id JOIN refs r ON r.ref_id = k.ref_id), "
        "w AS (SELECT *, CASE WHEN none THEN w2 ELSE w1 END * wa AS weight, CASE WHEN none THEN 1 ELSE 0 END AS flags FROM (SELECT *, max(w1) OVER (PARTITION BY target_id) < 1.1754943508222875e-38 AS none FROM raw))"
    )


WEIGHTS = f"{BASE}, {knn()}, {weighted()}"

#: Densities of targets over the grid: z, p by bin.
PDZ = (
    WEIGHTS + ", grid AS (SELECT b AS bin, b * 25e-2 AS zb FROM range(-8, 57) g(b)), "
    "added AS (SELECT target_id, bin, zb, greatest(sum(weight * exp(-5e-1 * pow((zb - z) / 7e-1, 2e0))) / sum(weight), 0e0) AS p FROM w CROSS JOIN grid GROUP BY ALL), "
    "area AS (SELECT target_id, sum((p + pp) / 2e0 * (zb - pz)) AS a FROM (SELECT *, lag(p) OVER o AS pp, lag(zb) OVER o AS pz FROM added WINDOW o AS (PARTITION BY target_id ORDER BY bin)) WHERE pp IS NOT NULL GROUP BY target_id), "
    "pdf AS (SELECT target_id, bin, zb, p / a AS p FROM added JOIN area USING (target_id))"
)


def steps(source: str) -> str:
    """CTEs with the running integral c of a density, cp before each knot, its total, and the knot before."""
    return (
        f"st AS (SELECT *, lag(p) OVER o AS pp, lag(zb) OVER o AS pz FROM {source} WINDOW o AS (PARTITION BY target_id ORDER BY bin)), "
        "cs AS (SELECT *, sum(coalesce((p + pp) / 2e0 * (zb - pz), 0e0)) OVER (PARTITION BY target_id ORDER BY bin) AS c FROM st), "
        "cdf AS (SELECT *, lag(c) OVER (PARTITION BY target_id ORDER BY bin) AS cp, max(c) OVER (PARTITION BY target_id) AS tot FROM cs)"
    )


def quantile(q: str) -> str:
    return f"SELECT target_id, pz + ({q} * tot - cp) / (c - cp) * (zb - pz) AS v FROM cdf WHERE cp <= {q} * tot AND {q} * tot < c"


#: Stratified draws of samples, 40 a target.
DRAWS = (
    WEIGHTS + f", acc AS (SELECT *, sum(weight) OVER (PARTITION BY target_id ORDER BY rank) AS hi, sum(weight) OVER (PARTITION BY target_id) AS tot FROM w), "
    "u AS (SELECT acc.*, g.n AS draw, (g.n + 5e-1) / 4e1 * tot AS u FROM acc CROSS JOIN range(0, 40) g(n)), "
    f"picked AS (SELECT target_id, draw, ref_id, z, CAST(least(floor((u - (hi - weight)) / weight * {SAMPLES}), {SAMPLES - 1}) AS BIGINT) AS sample_no FROM u WHERE hi - weight <= u AND u < hi), "
    "drawn AS (SELECT *, z + CAST((ref_id * 7 + sample_no * 13) % 41 - 20 AS DOUBLE) / 1e1 AS p1, CAST((ref_id * 3 + sample_no * 17) % 29 AS DOUBLE) / 1e1 AS p2, CAST((ref_id + sample_no * 5) % 8 AS INT) AS i1 FROM picked)"
)


def bucket(x: str, edges: list[float]) -> str:
    last = len(edges) - 2
    return "CASE " + " ".join(f"WHEN {x} >= {a}e0 AND {x} {'<=' if i == last else '<'} {b}e0 THEN {i}" for i, (a, b) in enumerate(zip(edges, edges[1:]))) + " END"


def dereddened(sign: str = "") -> str:
    return ", ".join(r(f"f_{b} * pow(1e1, {sign}{COEFFICIENTS[b]}e0 * ebv / 25e-1)", f"f_{b}") for b in BANDS)
