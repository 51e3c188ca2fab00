"""Queries of route choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import choice as C
from trackloom.operators.search import coordinate_search
from trackloom.plans.registry import q4, q6, query, r4, r6

_ROUTES = ", r AS (SELECT path_id // 20 AS od, path_id AS route, seq, floor(x / 25) * 25 AS x, floor(y / 25) * 25 AS y FROM track)"
_LEGS = _ROUTES + """
, s AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM r WINDOW w AS (PARTITION BY od, route ORDER BY seq)),
l AS (SELECT od, route, CASE WHEN (x, y) <= (x1, y1) THEN (x, y, x1, y1) ELSE (x1, y1, x, y) END AS key, sqrt(pow(x1 - x, 2) + pow(y1 - y, 2)) AS length FROM s WHERE x1 IS NOT NULL)"""


def _routes(track: DataFrame) -> DataFrame:
    """All paths as routes on a 25-unit grid; twenty paths a group, so that groups grow in number with the data."""
    return track.select(F.floor(F.col("path_id") / 20).alias("od"), F.col("path_id").alias("route"), "seq", (F.floor(F.col("x") / 25) * 25.0).alias("x"), (F.floor(F.col("y") / 25) * 25.0).alias("y"))


@query("track", _LEGS + f" SELECT od, route, count(DISTINCT key) AS keys, {q6('sum(length)')} AS length FROM l GROUP BY od, route")
def sca_33_edge_keys(track: DataFrame) -> DataFrame:
    return C.keyed_segments(_routes(track), "od", "route").groupBy("od", "route").agg(F.count_distinct("key").alias("keys"), r6(F.sum("length")).alias("length"))


@query("track", _LEGS + f"""
, u AS (SELECT od, key, count(DISTINCT route) AS used FROM l GROUP BY od, key), t AS (SELECT od, route, sum(length) AS total FROM l GROUP BY od, route), n AS (SELECT od, count(DISTINCT route) AS n FROM l GROUP BY od)
SELECT od, route, {q6('CASE WHEN any_value(n) = 1 THEN 1 ELSE least(greatest(sum(length / total / used), 0.001), 1) END')} AS path_size FROM l JOIN u USING (od, key) JOIN t USING (od, route) JOIN n USING (od) GROUP BY od, route""")
def grp_24_path_size(track: DataFrame) -> DataFrame:
    return C.path_sizes(_routes(track), "od", "route").select("od", "route", r6("path_size").alias("path_size"))


@query("candidates", f", u AS (SELECT od, idx, path_size * exp(-(cost_equiv_m - min(cost_equiv_m) OVER (PARTITION BY od)) / 5) AS u FROM candidates) SELECT od, idx, {q6('u / sum(u) OVER (PARTITION BY od)')} AS probability FROM u")
def grp_25_probabilities(candidates: DataFrame) -> DataFrame:
    return C.probabilities(candidates, "od", "cost_equiv_m", "path_size", 5.0).select("od", "idx", r6("probability").alias("probability"))


_OVERLAP = _LEGS + """
, k AS (SELECT od, route, key, sum(length) AS length FROM l GROUP BY ALL), t AS (SELECT od, route, sum(length) AS total FROM k GROUP BY ALL),
o AS (SELECT a.od, a.route AS a, b.route AS b, sum(least(a.length, b.length)) AS shared FROM k a JOIN k b ON a.od = b.od AND a.key = b.key AND a.route < b.route GROUP BY ALL)"""


@query("track", _OVERLAP + f" SELECT o.od, o.a, o.b, {q6('shared / least(x.total, z.total)')} AS overlap FROM o JOIN t x ON x.od = o.od AND x.route = o.a JOIN t z ON z.od = o.od AND z.route = o.b")
def grp_26_overlap(track: DataFrame) -> DataFrame:
    return C.overlaps(_routes(track), "od", "route").select("od", "a", "b", r6("overlap").alias("overlap"))


@query("track")
def grp_27_distinct_routes(track: DataFrame) -> DataFrame:
    routes = _routes(track)
    return C.distinct_routes(routes, C.overlaps(routes, "od", "route"), "od", "route", 0.05, 5)


@query("candidates", f", b AS (SELECT od, idx, cost_equiv_m, row_number() OVER (PARTITION BY od ORDER BY cost_equiv_m, idx) AS p FROM candidates) SELECT od, idx AS best, {q6('cost_equiv_m')} AS cost FROM b WHERE p = 1")
def jon_22_best_of_group(candidates: DataFrame) -> DataFrame:
    best = candidates.groupBy("od").agg(F.min(F.struct("cost_equiv_m", "idx")).alias("m"))
    return best.select("od", F.col("m.idx").cast("long").alias("best"), r6(F.col("m.cost_equiv_m")).alias("cost"))


_LOSS = "(sxx - 2 * {x} * sx + n * {x} * {x}) / n / 100 + (syy - 2 * {y} * sy + n * {y} * {y}) / n / 10000"
_PICK = "arg_min(struct_pack(x := cx, y := cy, loss := cl), (cl, c)) FILTER (cx BETWEEN 1 AND 50 AND cy BETWEEN 900 AND 2100)"


@query("part", f"""
, s AS (SELECT p_brand, count(*) AS n, sum(p_size) AS sx, sum(p_size * p_size) AS sxx, sum(p_retailprice) AS sy, sum(p_retailprice * p_retailprice) AS syy FROM part GROUP BY p_brand),
r(p_brand, k, x, y, loss, hx, hy, tried, done) AS (
SELECT p_brand, 0, 25e0, 1500e0, {_LOSS.format(x='25e0', y='1500e0')}, 49 * 0.15::DOUBLE, 1200 * 0.15::DOUBLE, 1, false FROM s
UNION ALL SELECT p_brand, any_value(k) + 1, CASE WHEN any_value(loss) - 2e-16 > {_PICK}.loss THEN {_PICK}.x ELSE any_value(x) END, CASE WHEN any_value(loss) - 2e-16 > {_PICK}.loss THEN {_PICK}.y ELSE any_value(y) END,
least(any_value(loss), CASE WHEN any_value(loss) - 2e-16 > {_PICK}.loss THEN {_PICK}.loss ELSE any_value(loss) END),
CASE WHEN NOT any_value(loss) - 2e-16 > {_PICK}.loss AND any_value(hx) > 0.49::DOUBLE THEN any_value(hx) / 2 ELSE any_value(hx) END, CASE WHEN NOT any_value(loss) - 2e-16 > {_PICK}.loss AND any_value(hy) > 12::DOUBLE THEN any_value(hy) / 2 ELSE any_value(hy) END,
any_value(tried) + count(*) FILTER (cx BETWEEN 1 AND 50 AND cy BETWEEN 900 AND 2100), any_value(tried) + count(*) FILTER (cx BETWEEN 1 AND 50 AND cy BETWEEN 900 AND 2100) >= 400 OR (NOT any_value(loss) - 2e-16 > {_PICK}.loss AND NOT (any_value(hx) > 0.49::DOUBLE OR any_value(hy) > 12::DOUBLE))
FROM (SELECT r.*, c, x + CASE c WHEN 0 THEN hx WHEN 1 THEN -hx ELSE 0 END AS cx, y + CASE c WHEN 2 THEN hy WHEN 3 THEN -hy ELSE 0 END AS cy, {_LOSS.format(x='(x + CASE c WHEN 0 THEN hx WHEN 1 THEN -hx ELSE 0 END)', y='(y + CASE c WHEN 2 THEN hy WHEN 3 THEN -hy ELSE 0 END)')} AS cl FROM r JOIN s USING (p_brand), (SELECT unnest([0, 1, 2, 3]) AS c) WHERE NOT done) GROUP BY p_brand)
SELECT p_brand, {q4('arg_max(x, k)')} AS size, {q4('arg_max(y, k)')} AS price, {q4('arg_max(loss, k)')} AS loss FROM r GROUP BY p_brand""")
def jon_22_coordinate_search(part: DataFrame) -> DataFrame:
    """For each brand the size and price with the least mean squared distance to its parts."""
    sums = part.groupBy("p_brand").agg(F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(c) for a, b, c in (("p_size", "p_size", "sxx"), ("p_retailprice", "p_retailprice", "syy"))], F.sum("p_size").alias("sx"), F.sum("p_retailprice").alias("sy"))

    def score(candidates: DataFrame) -> DataFrame:
        n, x, y = F.col("n"), F.col("size"), F.col("price")
        loss = (F.col("sxx") - 2 * x * F.col("sx") + n * x * x) / n / 100 + (F.col("syy") - 2 * y * F.col("sy") + n * y * y) / n / 10000
        return candidates.join(sums, "p_brand").select("p_brand", "candidate", loss.alias("loss"))

    start = sums.select("p_brand", F.lit(25.0).alias("size"), F.lit(1500.0).alias("price"))
    got = coordinate_search(start, "p_brand", {"size": (1.0, 50.0), "price": (900.0, 2100.0)}, score)
    return got.select("p_brand", *[r4(c).alias(c) for c in ("size", "price", "loss")])
