"""SQL that states cost, bottleneck and arrival fields shell by shell, for the oracle.

One common table per shell and per sideways step: the recurrence itself, with rows in place of
arrays, on the fixture grid.
"""

from __future__ import annotations

import math

from terravox.sources import tables as T

ROW_KM = T.DLAT * math.pi / 180 * 6371.0


def base_sql(ncell: int) -> str:
    n = T.NLON
    moves = ", ".join(f"({c}, {dj * c}, {di * c})" for c in range(1, ncell + 1) for dj, di in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    return f"""{T.CELLS_SQL},
ac AS MATERIALIZED (SELECT model, k, j, i, greatest(-6.0::DOUBLE, least(6.0::DOUBLE, anom)) AS a,
   {T.DLON} * pi() / 180 * 6371.0 * greatest(cos(radians(lat)), 0.02::DOUBLE) AS colkm FROM cells),
step4(dj, di) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)),
mv{ncell}(n, dj, di) AS (VALUES {moves}),
w AS MATERIALIZED (
  SELECT model, 1 AS dk, k, j, i, colkm, avg(a) OVER (PARTITION BY model, j, i ORDER BY k ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS m,
         max(a) OVER (PARTITION BY model, j, i ORDER BY k ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS x FROM ac
  UNION ALL
  SELECT model, 4, k, j, i, colkm, avg(a) OVER (PARTITION BY model, j, i ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING),
         max(a) OVER (PARTITION BY model, j, i ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) FROM ac),
wm AS MATERIALIZED (SELECT w.*, v.n, v.dj, j + v.dj AS j2, (i + v.di + {n}) % {n} AS i2, j + v.dj // v.n AS jm, (i + v.di // v.n + {n}) % {n} AS im
  FROM w CROSS JOIN mv{ncell} AS v WHERE k + dk < {T.NZ} AND j + v.dj BETWEEN 0 AND {T.NLAT - 1}),
w3 AS MATERIALIZED (
  SELECT wm.model, wm.dk, wm.k, wm.j, wm.i, j2, i2, n, dj, wm.colkm,
         CASE WHEN n = 1 THEN (wm.m + b.m) / 2 ELSE (wm.m + c.m + b.m) / 3 END AS seg, greatest(wm.x, b.x, c.x) AS top
  FROM wm JOIN w AS b ON b.model = wm.model AND b.dk = wm.dk AND b.k = wm.k AND b.j = wm.j2 AND b.i = wm.i2
  JOIN w AS c ON c.model = wm.model AND c.dk = wm.dk AND c.k = wm.k AND c.j = wm.jm AND c.i = wm.im)"""


def price_sql(tag: str, s: float, lateral: float) -> str:
    """All moves of one case: model, k, kt, j, i, j2, i2, p (price) and top (worst anomaly)."""
    return f"""p{tag} AS MATERIALIZED (
  SELECT a.model, a.k, a.k + 1 AS kt, a.j, a.i, a.j AS j2, a.i AS i2, {T.DZ_KM} * exp({s} * 0.5 * (a.a + b.a)) AS p, greatest(a.a, b.a) AS top
  FROM ac AS a JOIN ac AS b ON b.model = a.model AND b.j = a.j AND b.i = a.i AND b.k = a.k + 1
  UNION ALL
  SELECT model, k, k + dk, j, i, j2, i2, sqrt(pow({T.DZ_KM} * dk, 2) + pow({lateral} * n * (CASE WHEN dj <> 0 THEN {ROW_KM!r} ELSE colkm END), 2)) * exp({s} * seg), top FROM w3)"""


def _relax(src: str, s: float, lateral: float, kind: str, extra: str = "", ban: str | None = None) -> str:
    """One sideways step as a SELECT from ``src`` (model, extra, k, j, i, c).

    Cells that cannot be reached have no row: every row offers its value to itself and to its four
    neighbours, and the smallest offer wins.
    """
    n, e = T.NLON, f"{extra}, " if extra else ""
    nj, ni = "q.j - t.dj", f"(q.i - t.di + {n}) % {n}"
    at_j, at_i = ("q.j", "q.i") if kind == "arrival" else (nj, ni)
    width = f"(CASE WHEN t.dj <> 0 THEN {ROW_KM!r} ELSE x.colkm END)"
    cand = "greatest(q.c, x.a)" if kind == "bottleneck" else f"q.c + {lateral} * {width} * exp({s} * x.a)"
    qe = f"q.{extra}, " if extra else ""
    return f"""SELECT model, {e}k, j, i, min(c) AS c FROM (
    SELECT model, {e}k, j, i, c FROM {src}
    UNION ALL
    SELECT q.model, {qe}q.k, {nj}, {ni}, {cand} FROM {src} AS q CROSS JOIN step4 AS t
    JOIN ac AS x ON x.model = q.model AND x.k = q.k AND x.j = {at_j} AND x.i = {at_i}
    WHERE {nj} BETWEEN 0 AND {T.NLAT - 1}) AS d {_allowed(ban)} GROUP BY model, {e}k, j, i"""


def _allowed(ban: str | None) -> str:
    return f"WHERE NOT EXISTS (SELECT 1 FROM {ban} AS z WHERE z.model = d.model AND z.k = d.k AND z.j = d.j AND z.i = d.i)" if ban else ""


def field_sql(tag: str, k0: int, s: float, lateral: float, steps: int, kind: str = "cost", ban: str | None = None) -> str:
    """Recursive table r<tag> and its result f<tag> (model, k, j, i, c).

    One step of the recursion is one shell. The last four shells travel along, because a slanted
    move spans one or four; ``ban`` names a table (model, k, j, i) of forbidden cells.
    """
    val = "0.0::DOUBLE" if kind == "cost" else "a"
    start = f"SELECT model, k, j, i, {val} AS c FROM ac AS d {_allowed(ban) + ' AND' if ban else 'WHERE'} d.k = {k0}"
    for _ in range(steps if kind == "bottleneck" else 0):
        start = _relax(f"({start})", s, lateral, kind, ban=ban)
    step = "p.p + t.c" if kind == "cost" else "greatest(p.top, t.c)"
    chain = [f"""y0 AS (SELECT model, k, j, i, min(v) AS c FROM (
      SELECT p.model, p.k, p.j, p.i, {step} AS v FROM r{tag} AS t JOIN p{tag} AS p ON p.model = t.model AND p.k = t.cur - 1 AND p.kt = t.k AND p.j2 = t.j AND p.i2 = t.i) AS d
      {_allowed(ban)} GROUP BY model, k, j, i)"""]
    chain += [f"y{b + 1} AS ({_relax(f'y{b}', s, lateral, kind, ban=ban)})" for b in range(steps)]
    return f"""r{tag} AS (
  SELECT *, true AS fresh, {k0} AS cur FROM ({start}) AS u
  UNION ALL
  SELECT * FROM (WITH {", ".join(chain)}
    SELECT *, true AS fresh, k AS cur FROM y{steps}
    UNION ALL SELECT model, k, j, i, c, false, cur - 1 FROM r{tag} WHERE k <= cur + 2 AND cur > 0) AS w),
f{tag} AS MATERIALIZED (SELECT model, k, j, i, c FROM r{tag} WHERE fresh)"""


def arrival_sql(tag: str, seed: str, k_seed: int, k0: int, s: float, lateral: float, steps: int) -> str:
    """Recursive table q<tag> and its result a<tag> (model, cap, k, j, i, c): arrivals per cap of
    ``seed`` (model, cap, j, i)."""
    chain = [f"""y0 AS (SELECT p.model, t.cap, p.kt AS k, p.j2 AS j, p.i2 AS i, min(p.p + t.c) AS c FROM q{tag} AS t
      JOIN p{tag} AS p ON p.model = t.model AND p.k = t.k AND p.kt = t.cur + 1 AND p.j = t.j AND p.i = t.i WHERE NOT t.arr AND t.cur < {k0} GROUP BY ALL)"""]
    chain += [f"y{b + 1} AS ({_relax(f'y{b}', s, lateral, 'arrival', 'cap')})" for b in range(steps)]
    first = f"SELECT model, cap, {k_seed} AS k, j, i, 0.0::DOUBLE AS c FROM {seed}"
    left = first
    for _ in range(steps):
        left = _relax(f"({left})", s, lateral, "arrival", "cap")
    return f"""q{tag} AS (
  SELECT *, true AS arr, {k_seed} AS cur FROM ({first}) AS u UNION ALL SELECT *, false, {k_seed} FROM ({left}) AS v
  UNION ALL
  SELECT * FROM (WITH {", ".join(chain)}
    SELECT *, true AS arr, k AS cur FROM y0 UNION ALL SELECT *, false, k FROM y{steps}
    UNION ALL SELECT model, cap, k, j, i, c, false, cur + 1 FROM q{tag} WHERE NOT arr AND k >= cur - 2 AND cur < {k0}) AS w),
a{tag} AS MATERIALIZED (SELECT model, cap, k, j, i, c FROM q{tag} WHERE arr)"""


def caps_sql(radius: float) -> str:
    """places with their seed caps, and the cells of each cap."""
    n = T.NLON
    return f"""capped AS (SELECT *, greatest(0, pj - 1) AS cj0, least({T.NLAT - 1}, pj + 1) AS cj1 FROM (
  SELECT kind, site, n_sites, lat, least({T.NLAT - 1}, greatest(0, ceil(round((lat + 85.5) / 9.0, 9) - 0.5)))::BIGINT AS pj,
    ((ceil(round((lon + 180.0) / 14.4, 9) - 0.5)::BIGINT % {n}) + {n}) % {n} AS ci,
    greatest(1, round_even({radius} / 14.4 / greatest(cos(radians(lat)), 0.05::DOUBLE), 0))::BIGINT AS cw FROM places) AS z),
capcells AS (SELECT DISTINCT cj0, cj1, ci, cw, j.j, ((ci + x.x) % {n} + {n}) % {n} AS i FROM capped, LATERAL (SELECT unnest(range(cj0, cj1 + 1)) AS j) AS j, LATERAL (SELECT unnest(range(-cw, cw + 1)) AS x) AS x)"""
