"""Queries of the learners that rest on neighbours, Gram matrices and splines."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import normal
from tallyforge.functions.gamma import TRIES, gamma
from tallyforge.operators import agglomerate, attributions, gram, neighbours, splines
from tallyforge.operators.simulate import uniform
from tallyforge.plans.registry import SQL, query, table
from tallyforge.plans.season import SEASON_SQL, season
from tallyforge.plans.single import PICKS_SQL, pick_values
from tallyforge.sources import model_store
from tallyforge.sources.shared import folder

#: Neighbours of a row, and the share of rows that are asked for in an exact search: ids divisible by ASKED.
K, ASKED = 10, 20

_GAP = "sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2))))"


def _near(asked=""):
    return f"""near AS (SELECT * FROM (SELECT a.vec_id, a.label AS own, b.vec_id AS neighbour, b.label, {_GAP} AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_GAP}, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id{asked}) WHERE rank <= {K})"""


_NEAR = _near(f" WHERE a.vec_id % {ASKED} = 0")


def _exact(e):
    return neighbours.nearest(e, "vec_id", "embedding", K, asked=F.col("vec_id") % ASKED == 0)


def _listed(found):
    out = found.select("vec_id", F.posexplode("neighbours").alias("rank", "n"))
    return out.select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("neighbour"), F.round("n.distance", 5).alias("distance"))


@query("ml4_nearest_exact", f"WITH {_NEAR} SELECT vec_id, CAST(rank AS INT) AS rank, neighbour, round(distance, 5) AS distance FROM near")
def ml4_exact(spark, d):
    """The nearest vectors of those whose id is divisible by ASKED, against all, in blocks."""
    return _listed(_exact(table(spark, d, "embeddings")))


ML4_VOTE_SQL = f"""WITH {_near()}, c AS (SELECT vec_id, own, label, count(*) AS n FROM near GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS rn FROM c)
SELECT vec_id, own AS label, max(CASE WHEN rn = 1 THEN label END) AS predicted, max(n) AS votes, round(sum(n * label) / sum(n), 6) AS mean FROM r GROUP BY vec_id, own"""


@query("ml4_neighbour_vote", ML4_VOTE_SQL)
def ml4_vote(spark, d):
    """For every vector the label that most of its nearest have, and the mean of their labels."""
    e = table(spark, d, "embeddings")
    out = neighbours.votes(e, neighbours.nearest(e, "vec_id", "embedding", K), "vec_id", "label")
    return e.select("vec_id", "label").join(out, "vec_id").select("vec_id", "label", "predicted", "votes", F.round("mean", 6).alias("mean"))


@query("ml4_index_neighbours")
def ml4_index(spark, d):
    """The nearest vectors of every row, by the index."""
    e = table(spark, d, "embeddings")
    return _listed(neighbours.nearest(e, "vec_id", "embedding", K, neighbours.fit(e, "vec_id", "embedding", K)))


@query("ml4_index_recall")
def ml4_recall(spark, d):
    """How many of the true neighbours of the asked rows the index finds."""
    e = table(spark, d, "embeddings")
    index = neighbours.fit(e, "vec_id", "embedding", K)
    found = neighbours.nearest(e, "vec_id", "embedding", K, index, asked=F.col("vec_id") % ASKED == 0)
    return neighbours.recall_of(found, _exact(e), "vec_id")


_UNIFORM = "(CAST('0x' || substr(md5('{0}:' || base || ':' || turn), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE"
ML15_SQL = f"""WITH pairs AS (SELECT a.label, a.vec_id AS base, b.vec_id AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_GAP}, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
lists AS (SELECT label, base, list(other ORDER BY rank) AS near FROM pairs WHERE rank <= 5 GROUP BY ALL), sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
turns AS (SELECT l.*, n, (SELECT max(n) FROM sizes) - n AS want, row_number() OVER (PARTITION BY l.label ORDER BY base) AS place FROM lists l JOIN sizes s ON l.label = s.label),
made AS (SELECT label, base, near, unnest(range(1, want // n + CASE WHEN place <= want % n THEN 1 ELSE 0 END + 1)) AS turn FROM turns),
picked AS (SELECT label, base, turn, near[CAST(floor({_UNIFORM.format(1)} * len(near)) AS INT) + 1] AS other, {_UNIFORM.format(2)} AS place FROM made),
vectors AS (SELECT p.*, list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE + place * (b.embedding[i]::DOUBLE - a.embedding[i]::DOUBLE)) AS v FROM picked p JOIN embeddings a ON a.vec_id = base JOIN embeddings b ON b.vec_id = other)
SELECT label, base, other, turn, round(place, 6) AS place, round(v[1], 5) AS first, round(list_sum(v), 5) AS total FROM vectors"""


@query("ml15_made_rows", ML15_SQL)
def ml15_made(spark, d):
    """Made rows between neighbours of a class, until all classes have as many rows as the largest; the neighbours are exact."""
    e = table(spark, d, "embeddings")
    out = neighbours.oversampled(e, "vec_id", "embedding", "label")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return out.select("label", "base", "other", F.col("turn").cast("long"), F.round("place", 6).alias("place"), F.round(F.col("embedding")[0], 5).alias("first"), F.round(total, 5).alias("total"))


#: Covariances of three features and a target by group: what all models of them rest on.
_COV = SEASON_SQL + """, x AS (SELECT player, yr, pos, player % 5 AS fold, CAST(games AS DOUBLE) AS a, CAST(yr - 1995 AS DOUBLE) AS b, team / 10.0::DOUBLE AS c, pts / 1e5 AS y FROM season)"""
_MEANS = "avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, b) AS bb, covar_pop(b, c) AS bc, covar_pop(c, c) AS cc, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(c, y) AS cy"
FEATURES = ["a", "b", "c"]


def _three(spark, d):
    double = lambda c: c.cast("double")
    x = season(spark, d)
    return x.select("player", "yr", "pos", (F.col("player") % 5).cast("int").alias("fold"), double(F.col("games")).alias("a"), double(F.col("yr") - 1995).alias("b"), (F.col("team") / 10.0).alias("c"), (F.col("pts") / 1e5).alias("y"))


def _shown(rows, models):
    out = gram.predicted(rows, models, FEATURES, ["pos"], "predicted")
    return out.select("player", "yr", F.round("predicted", 5).alias("predicted"))


_SHOWN = "SELECT x.player, x.yr, round(w.my + p * (x.a - w.ma) + q * (x.b - w.mb) + r * (x.c - w.mc), 5) AS predicted FROM x JOIN"


ML1_RIDGE_SQL = f"""WITH {_COV}, m AS (SELECT pos, count(*) AS n, {_MEANS} FROM x GROUP BY pos), r AS (SELECT *, aa + 0.3 AS A, bb + 0.3 AS B, cc + 0.3 AS C FROM (SELECT pos, n, ma, mb, mc, my, aa, ab, ac, bb, bc, cc, ay, by_, cy FROM m)),
d AS (SELECT *, aa_ * (bb_ * cc_ - bc * bc) - ab * (ab * cc_ - bc * ac) + ac * (ab * bc - bb_ * ac) AS det FROM (SELECT pos, n, ma, mb, mc, my, aa + 0.3 AS aa_, ab, ac, bb + 0.3 AS bb_, bc, cc + 0.3 AS cc_, ay, by_, cy FROM m)),
s AS (SELECT pos, n, ma, mb, mc, my, (ay * (bb_ * cc_ - bc * bc) - ab * (by_ * cc_ - bc * cy) + ac * (by_ * bc - bb_ * cy)) / det AS p, (aa_ * (by_ * cc_ - bc * cy) - ay * (ab * cc_ - bc * ac) + ac * (ab * cy - by_ * ac)) / det AS q,
  (aa_ * (bb_ * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb_ * ac)) / det AS r FROM d)
{_SHOWN} s AS w ON x.pos = w.pos"""
ML1_RIDGE_SQL = ML1_RIDGE_SQL.replace(", r AS (SELECT *, aa + 0.3 AS A, bb + 0.3 AS B, cc + 0.3 AS C FROM (SELECT pos, n, ma, mb, mc, my, aa, ab, ac, bb, bc, cc, ay, by_, cy FROM m))", "")


@query("ml1_gram_ridge", ML1_RIDGE_SQL)
def ml1_ridge(spark, d):
    """Ridge of three features for each position, from one pass."""
    x = _three(spark, d)
    return _shown(x, gram.fitted(gram.sums(x, FEATURES, "y", ["pos"]), 0.3, 0.0))


def _descent(source: str, keys: str, weight: str, l1: str, rounds: int = 60, name: str = "walk") -> str:
    """Coordinate descent in SQL: a step of the recursion goes once through the three coefficients."""
    soft = lambda rest, own: f"sign({rest}) * greatest(abs({rest}) - {weight} * {l1}, 0) / ({own} + {weight} * (1 - {l1}))"
    cells = f"{keys}, ma, mb, mc, my, aa, ab, ac, bb, bc, cc, ay, by_, cy"
    return f"""{name} AS (SELECT {cells}, 0 AS turn, 0.0::DOUBLE AS p, 0.0::DOUBLE AS q, 0.0::DOUBLE AS r FROM {source} UNION ALL
  SELECT {cells}, turn, p, q, {soft("(cy - ac * p - bc * q)", "cc")} AS r FROM (SELECT {cells}, turn, p, {soft("(by_ - ab * p - bc * r)", "bb")} AS q, r FROM (
    SELECT {cells}, turn + 1 AS turn, {soft("(ay - ab * q - ac * r)", "aa")} AS p, q, r FROM {name} WHERE turn < {rounds})))"""


ML1_NET_SQL = f"""WITH RECURSIVE {_COV}, m AS (SELECT pos, count(*) AS n, {_MEANS} FROM x GROUP BY pos), {_descent("m", "pos, n", "0.02", "0.8")}
{_SHOWN} walk AS w ON x.pos = w.pos WHERE turn = 60"""


@query("ml1_gram_net", ML1_NET_SQL)
def ml1_net(spark, d):
    """Elastic net of three features for each position, by coordinate descent on the Gram matrix."""
    x = _three(spark, d)
    return _shown(x, gram.fitted(gram.sums(x, FEATURES, "y", ["pos"]), 0.02, 0.8))


ML1_BAYES_SQL = f"""WITH RECURSIVE {_COV}, m AS (SELECT pos, count(*)::DOUBLE AS n, {_MEANS}, var_pop(y) AS yy FROM x GROUP BY pos),
e AS (SELECT pos, n, ma, mb, my, n * yy AS yy, n * aa AS aa, n * ab AS ab, n * bb AS bb, n * ay AS ay, n * by_ AS by_, 1 / yy AS noise, 1.0::DOUBLE AS spread, 0 AS turn FROM m
  UNION ALL SELECT pos, n, ma, mb, my, yy, aa, ab, bb, ay, by_, (n - known + 2e-6) / (yy - 2 * (ay * p + by_ * q) + aa * p * p + 2 * ab * p * q + bb * q * q + 2e-6) AS noise, (known + 2e-6) / (p * p + q * q + 2e-6) AS spread, turn + 1 AS turn FROM (
    SELECT *, noise * (ay * B - by_ * O) / det AS p, noise * (by_ * A_ - ay * O) / det AS q, 2 - spread * (A_ + B) / det AS known FROM (SELECT *, A_ * B - O * O AS det FROM (
      SELECT *, spread + noise * aa AS A_, spread + noise * bb AS B, noise * ab AS O FROM e WHERE turn < 200)))),
f AS (SELECT *, (spread + noise * aa) * (spread + noise * bb) - noise * ab * noise * ab AS det FROM e WHERE turn = 200),
g AS (SELECT *, noise * (ay * (spread + noise * bb) - by_ * noise * ab) / det AS p, noise * (by_ * (spread + noise * aa) - ay * noise * ab) / det AS q FROM f)
SELECT player, yr, round(my + p * (x.a - ma) + q * (x.b - mb), 5) AS predicted, round(1 / sqrt(noise), 5) AS deviation FROM x JOIN g ON x.pos = g.pos"""


@query("ml1_bayesian_ridge", ML1_BAYES_SQL)
def ml1_bayes(spark, d):
    """Ridge whose penalty comes from the evidence."""
    x = _three(spark, d)
    models = gram.fitted(gram.sums(x, ["a", "b"], "y", ["pos"]), bayesian=True)
    out = gram.joined(gram.predicted(x, models, ["a", "b"], ["pos"], "predicted"), models.select("pos", (1 / F.sqrt("tf_noise")).alias("deviation")), ["pos"])
    return out.select("player", "yr", F.round("predicted", 5).alias("predicted"), F.round("deviation", 5).alias("deviation"))


GRID = [(w, x) for w in (0.0003, 0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0) for x in (0.1, 0.5, 0.9)]
ML11_SQL = f"""WITH RECURSIVE {_COV}, f AS (SELECT DISTINCT pos, fold FROM x), t AS (SELECT unnest([{", ".join(str(w) for w, _ in GRID)}])::DOUBLE AS weight, unnest([{", ".join(str(x) for _, x in GRID)}])::DOUBLE AS l1, unnest(range({len(GRID)})) AS trial),
m AS (SELECT f.pos, f.fold, {_MEANS} FROM f JOIN x ON f.pos = x.pos AND f.fold <> x.fold GROUP BY ALL), g AS (SELECT * FROM m, t), {_descent("g", "pos, fold, trial, weight, l1", "weight", "l1")},
v AS (SELECT pos, fold, count(*) AS n, {_MEANS}, var_pop(y) AS yy FROM x GROUP BY ALL),
e AS (SELECT w.pos, w.fold, w.trial, w.weight, w.l1, v.yy - 2 * (p * v.ay + q * v.by_ + r * v.cy) + p * p * v.aa + q * q * v.bb + r * r * v.cc + 2 * (p * q * v.ab + p * r * v.ac + q * r * v.bc) + pow(v.my - w.my - p * (v.ma - w.ma) - q * (v.mb - w.mb) - r * (v.mc - w.mc), 2) AS error
  FROM walk w JOIN v ON w.pos = v.pos AND w.fold = v.fold WHERE turn = 60),
r1 AS (SELECT pos, trial, row_number() OVER (PARTITION BY pos ORDER BY avg(error), trial) AS rn FROM e WHERE fold < 2 GROUP BY pos, trial),
r2 AS (SELECT pos, trial, row_number() OVER (PARTITION BY pos ORDER BY avg(error), trial) AS rn FROM e SEMI JOIN (SELECT pos AS p1, trial AS t1 FROM r1 WHERE rn <= {len(GRID) // 2}) ON pos = p1 AND trial = t1 WHERE fold < 4 GROUP BY pos, trial),
s AS (SELECT pos, trial, weight, l1, avg(error) AS error FROM e SEMI JOIN (SELECT pos AS p2, trial AS t2 FROM r2 WHERE rn <= {len(GRID) // 4}) ON pos = p2 AND trial = t2 GROUP BY ALL),
t1 AS (SELECT pos, trial, weight, l1, error FROM s QUALIFY row_number() OVER (PARTITION BY pos ORDER BY error, trial) = 1), m1 AS (SELECT x.pos, {_MEANS} FROM x GROUP BY x.pos),
g1 AS (SELECT m1.*, trial, weight, l1, error FROM m1 JOIN t1 ON m1.pos = t1.pos), {_descent("g1", "pos, trial, weight, l1, error", "weight", "l1", name="walk1")}
SELECT x.player, x.yr, CAST(trial AS INT) AS trial, round(error, 7) AS error, round(w.my + p * (x.a - w.ma) + q * (x.b - w.mb) + r * (x.c - w.mc), 5) AS predicted FROM x JOIN walk1 AS w ON x.pos = w.pos WHERE turn = 60"""


@query("ml11_halving_search", ML11_SQL)
def ml11_search(spark, d):
    """What the model with the best penalty of a grid says, a model for each position. The penalties are found by halving: two folds for all trials, four for half, five for a quarter."""
    x = _three(spark, d)
    won = gram.search(x, FEATURES, "y", ["pos"], "fold", 5, GRID)
    models = gram.fitted(gram.joined(gram.sums(x, FEATURES, "y", ["pos"]), won, ["pos"]))
    out = gram.joined(gram.predicted(x, models, FEATURES, ["pos"], "predicted"), won.select("pos", "trial", "error"), ["pos"])
    return out.select("player", "yr", "trial", F.round("error", 7).alias("error"), F.round("predicted", 5).alias("predicted"))


#: A curve's penalty for places one apart, and the recursions that solve its system: down and up again.
STIFF = 500.0
BZ18_SPLINE_SQL = f"""WITH RECURSIVE {PICKS_SQL},
k AS (SELECT slot AS i, med, med - 2 * lead(med) OVER o + lead(med, 2) OVER o AS bent, count(*) OVER () - 2 AS n FROM m WINDOW o AS (ORDER BY slot)),
down AS (SELECT i, n, {2 / 3 + 6 * STIFF}::DOUBLE AS d, ({1 / 6 - 4 * STIFF}::DOUBLE) / {2 / 3 + 6 * STIFF} AS l1, {STIFF}::DOUBLE / {2 / 3 + 6 * STIFF} AS l2, bent::DOUBLE AS z, 0.0::DOUBLE AS d0, 0.0::DOUBLE AS l20, 0.0::DOUBLE AS z0 FROM k WHERE i = 1
  UNION ALL SELECT i, n, d, ({1 / 6 - 4 * STIFF} - l10 * l2_ * d0) / d AS l1, {STIFF} / d AS l2, z, d0, l2_ AS l20, z0 FROM (
    SELECT k.i, k.n, {2 / 3 + 6 * STIFF} - w.l1 * w.l1 * w.d - w.l20 * w.l20 * w.d0 AS d, w.l1 AS l10, w.l2 AS l2_, w.d AS d0, k.bent - w.l1 * w.z - w.l20 * w.z0 AS z, w.z AS z0 FROM down w JOIN k ON k.i = w.i + 1 WHERE k.i <= k.n)),
up AS (SELECT i, z / d AS c, 0.0::DOUBLE AS c1 FROM down WHERE i = n
  UNION ALL SELECT d.i, d.z / d.d - d.l1 * u.c - d.l2 * u.c1 AS c, u.c AS c1 FROM up u JOIN down d ON d.i = u.i - 1),
s1 AS (SELECT k.i, med - {STIFF} * (coalesce(a.c, 0) - 2 * coalesce(b.c, 0) + coalesce(e.c, 0)) AS smooth FROM k LEFT JOIN up a ON a.i = k.i LEFT JOIN up b ON b.i = k.i - 1 LEFT JOIN up e ON e.i = k.i - 2)
SELECT CAST(i AS INT) AS slot, round(smooth, 3) AS smooth, round(min(smooth) OVER (ORDER BY i), 3) AS value FROM s1"""


@query("bz18_spline_curve", BZ18_SPLINE_SQL)
def bz18_spline(spark, d):
    """Value over replacement by pick: the median of each slot, a smoothing spline of given stiffness, its running minimum.
    The slots are a draft's places, of which there are 300."""
    curve = splines.curves(pick_values(spark, d), [], "slot", "med", penalty=STIFF)
    value = F.min("fitted").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    return curve.select(F.col("x").cast("int").alias("slot"), F.round("fitted", 3).alias("smooth"), F.round(value, 3).alias("value"))


@query("ml14_price_curves")
def ml14_curves(spark, d):
    """What each order's price differs from its segment's curve over the days, a spline whose penalty is chosen by leaving out."""
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.datediff("o_orderdate", F.lit("1992-01-01")).alias("day"), (F.col("o_totalprice") / 1e5).alias("price")).join(people, "o_custkey")
    curve = splines.curves(rows, ["c_mktsegment"], "day", "price")
    out = splines.at(rows, curve, ["c_mktsegment"], "day", "curve")
    return out.select("o_orderkey", F.round("curve", 6).alias("curve"), F.round(F.col("price") - F.col("curve"), 6).alias("rest"))


def _fraction_sql(x: str, parts: tuple) -> str:
    def polynomial(coefficients):
        out = repr(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            out = f"({out} * {x} + {c!r}::DOUBLE)"
        return out

    return f"({polynomial(parts[0])} / {polynomial(parts[1])})"


#: The standard normal quantile of a column p, as functions/normal.py has it.
_INVERSE_SQL = f"""CASE WHEN abs(p - 0.5) <= 0.425 THEN (p - 0.5) * {_fraction_sql("(0.180625 - (p - 0.5) * (p - 0.5))", normal.MIDDLE)}
  ELSE sign(p - 0.5) * CASE WHEN sqrt(-ln(least(p, 1 - p))) <= 5 THEN {_fraction_sql("(sqrt(-ln(least(p, 1 - p))) - 1.6)", normal.TAIL)} ELSE {_fraction_sql("(sqrt(-ln(least(p, 1 - p))) - 5)", normal.FAR)} END END"""
SM3_SQL = f"""WITH b AS (SELECT c_custkey AS base, greatest(c_acctbal, 0)::DOUBLE AS pay, unnest(range(1, 4)) AS turn FROM customer),
u AS (SELECT base, turn, pay, unnest([0, 1]) AS k, unnest([{_UNIFORM.format(11)}, {_UNIFORM.format(12)}]) AS p FROM b), z AS (SELECT base, turn, pay, k, {_INVERSE_SQL} AS z FROM u),
w AS (SELECT base, turn, pay, max(CASE WHEN k = 0 THEN abs(z) END) AS a, max(CASE WHEN k = 1 THEN z END) AS b FROM z GROUP BY ALL)
SELECT base AS c_custkey, turn AS draw, round(pay * (1 + 0.1 * (4 / sqrt(17.0::DOUBLE) * a + sqrt(1 - 16 / 17.0::DOUBLE) * b)), 4) AS pay FROM w"""


@query("sm3_skewed_noise", SM3_SQL)
def sm3(spark, d):
    """Three draws of every price with skew-normal noise, most of it upwards."""
    rows = table(spark, d, "customer").select("c_custkey", F.greatest("c_acctbal", F.lit(0)).cast("double").alias("pay"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("draw"))
    u = lambda seed: uniform(seed, F.col("c_custkey"), F.col("draw"))
    noise = normal.skewed(u(11), u(12), 4.0)
    return rows.select("c_custkey", F.col("draw").cast("long").alias("draw"), F.round(F.col("pay") * (1 + 0.1 * noise), 4).alias("pay"))


#: Of 120 terms of a series that sums up the distribution function; sm1's limits are 2.5 deviations away on both sides.
_SERIES_SQL = "list_reduce([{'t': z, 's': z, 'k': 0.0::DOUBLE}] || list_transform(range(1, 121), lambda k: {'t': z, 's': 0.0::DOUBLE, 'k': k::DOUBLE}), lambda a, b: {'t': a.t * b.t * b.t / (2 * b.k + 1), 's': a.s + a.t * b.t * b.t / (2 * b.k + 1), 'k': b.k}).s"
SM1_SQL = SEASON_SQL.join(["WITH ", f""", c AS (SELECT 0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * {_SERIES_SQL} AS below FROM (SELECT -2.5::DOUBLE AS z)),
b AS (SELECT player || ':' || yr AS base, pts / 10000 AS mean, unnest(range(0, 10)) AS turn FROM season),
u AS (SELECT base, turn, mean, below + {_UNIFORM.format(1)} * (1 - 2 * below) AS p FROM b, c)
SELECT base AS player, CAST(turn AS INT) AS draw, round(least(greatest(mean + mean / 5 * {_INVERSE_SQL}, mean / 2), mean * 1.5), 6) AS points FROM u"""])
SQL["sm1_truncated_normal_draws"] = SM1_SQL


#: What the measures of a line say alike is pooled: price, price less discount, price with tax, quantity, price of one, discount, tax.
LINE = {"price": "l_extendedprice", "paid": "l_extendedprice * (1 - l_discount)", "taxed": "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "quantity": "l_quantity", "each": "l_extendedprice / l_quantity", "discount": "l_discount", "tax": "l_tax"}
_PAIRS = [(a, b) for a in range(1, len(LINE) + 1) for b in range(1, len(LINE) + 1)]
_N = len(LINE)
ML7_GROUPS_SQL = f"""WITH RECURSIVE x AS (SELECT l_orderkey, l_linenumber, l_returnflag, {", ".join(f"{e} AS {c}" for c, e in LINE.items())} FROM lineitem),
d AS (SELECT l_returnflag, [{", ".join(f"1 - corr({list(LINE)[a - 1]}, {list(LINE)[b - 1]})" for a, b in _PAIRS)}] AS d, [{", ".join(f"avg({c})" for c in LINE)}] AS m, [{", ".join(f"stddev_pop({c})" for c in LINE)}] AS sd FROM x GROUP BY l_returnflag),
w AS (SELECT l_returnflag, d, [{", ".join(f"[{k}]" for k in range(1, _N + 1))}] AS c, {_N} AS n FROM d UNION ALL
  SELECT l_returnflag, d, list_sort(list_filter(list_transform(range(1, n + 1), lambda k: CASE WHEN k = best.i THEN list_sort(list_concat(c[best.i], c[best.j])) WHEN k = best.j THEN CAST(NULL AS INTEGER[]) ELSE c[k] END), lambda z: z IS NOT NULL)) AS c, n - 1 AS n FROM (
    SELECT *, list_min(list_transform(list_filter(flatten(list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 1), lambda j: {{'i': i, 'j': j}}))), lambda p: p.i < p.j), lambda p:
      {{'h': list_avg(flatten(list_transform(c[p.i], lambda a: list_transform(c[p.j], lambda b: d[(a - 1) * {_N} + b])))), 'i': p.i, 'j': p.j}})) AS best FROM w WHERE n > 3))
SELECT l_orderkey, l_linenumber, round(v[1], 5) AS first, round(v[2], 5) AS second, round(v[3], 5) AS third FROM (
  SELECT l_orderkey, l_linenumber, list_transform(w.c, lambda z: list_avg(list_transform(z, lambda k: ([{", ".join(f"x.{c}" for c in LINE)}][k] - d.m[k]) / d.sd[k]))) AS v FROM x JOIN w ON x.l_returnflag = w.l_returnflag AND w.n = 3 JOIN d ON x.l_returnflag = d.l_returnflag)"""


@query("ml7_feature_groups", ML7_GROUPS_SQL)
def ml7_groups(spark, d):
    """Seven measures of a line pooled to three by agglomeration over their correlations, for each return flag."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *(F.expr(e).alias(c) for c, e in LINE.items()))
    found = agglomerate.clustered(x, list(LINE), ["l_returnflag"], clusters=3)
    out = agglomerate.pooled(x, found, list(LINE), ["l_returnflag"], "parts")
    return out.select("l_orderkey", "l_linenumber", *(F.round(F.get("parts", F.lit(k)), 5).alias(n) for k, n in enumerate(("first", "second", "third"))))


@query("ml7_vector_groups")
def ml7_vectors(spark, d):
    """The places of all vectors pooled to eight by agglomeration over their correlations."""
    e = table(spark, d, "embeddings")
    n = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    places = [f"e{k}" for k in range(n)]
    x = e.select("vec_id", *(F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(places)))
    out = agglomerate.pooled(x, agglomerate.clustered(x, places, [], clusters=8), places, [], "parts")
    return out.select("vec_id", *(F.round(F.get("parts", F.lit(k)), 5).alias(f"p{k + 1}") for k in range(8)))


ML20_SQL = ML1_RIDGE_SQL[: ML1_RIDGE_SQL.index(_SHOWN)] + """SELECT x.player, x.yr, round(w.my, 5) AS base, round(p * (x.a - w.ma), 5) AS games, round(q * (x.b - w.mb), 5) AS years, round(r * (x.c - w.mc), 5) AS team FROM x JOIN s AS w ON x.pos = w.pos"""


@query("ml20_linear_parts", ML20_SQL)
def ml20_linear(spark, d):
    """What each feature adds to what a ridge model of the position says, from the position's mean on."""
    x = _three(spark, d)
    m = gram.sums(x, FEATURES, "y", ["pos"])
    out = attributions.linear(x, gram.fitted(m, 0.3, 0.0), attributions.group_means(m, 3), FEATURES, ["pos"], "part")
    return out.select("player", "yr", F.round("part_base", 5).alias("base"), *(F.round(F.col("part")[k], 5).alias(n) for k, n in enumerate(("games", "years", "team"))))


ML20_SIGN_SQL = ML1_RIDGE_SQL[: ML1_RIDGE_SQL.index(_SHOWN)] + """, u AS (SELECT player, yr, pos, unnest([1, 2, 3]) AS k, unnest([a, b, c]) AS v FROM x),
b AS (SELECT * FROM (SELECT pos, unnest([1, 2, 3]) AS k, unnest([p, q, r]) AS b FROM s) QUALIFY row_number() OVER (PARTITION BY pos ORDER BY abs(b) DESC, k) <= 2),
t AS (SELECT player, yr, u.pos, u.k, b, CASE WHEN b < 0 THEN ln(max(v) OVER (PARTITION BY u.pos, u.k) - v + 1) ELSE v END AS v FROM u JOIN b ON u.pos = b.pos AND u.k = b.k)
SELECT player, yr, round(avg(z), 5) AS score FROM (SELECT player, yr, abs(b) * (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM t WINDOW w AS (PARTITION BY pos, k)) GROUP BY player, yr"""


@query("ml20_signed_score", ML20_SIGN_SQL)
def ml20_signed(spark, d):
    """The two features that count most, turned to rise with the prediction, standardised and weighted."""
    x = _three(spark, d)
    models = gram.fitted(gram.sums(x, FEATURES, "y", ["pos"]), 0.3, 0.0)
    out = attributions.signed_score(x, models, FEATURES, ["pos"], 2, "score")
    return out.select("player", "yr", F.round("score", 5).alias("score"))


@query("ml20_tree_parts")
def ml20_trees(spark, d):
    """Shapley values of three features in a forest, with what the forest says."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="tf_f").transform(_three(spark, d))
    model = RandomForestRegressor(featuresCol="tf_f", labelCol="y", predictionCol="said", numTrees=8, maxDepth=5, seed=1).fit(rows)
    out = attributions.trees(model.transform(rows).drop("tf_f"), model, FEATURES, "part")
    return out.select("player", "yr", F.round("said", 5).alias("said"), F.round("part_base", 5).alias("base"), *(F.round(F.col("part")[k], 5).alias(n) for k, n in enumerate(("games", "years", "team"))))


ML17_SQL = SEASON_SQL.join(["WITH ", f""", s AS (SELECT player, count(*) AS n, avg(pts / 1e5) AS mean, var_pop(pts / 1e5) AS v FROM season GROUP BY player),
m AS (SELECT player, 2 + n AS k_n, (10 + n * mean) / (2 + n) AS m_n, 2 + n / 2.0::DOUBLE AS a_n, 2 + 0.5 * n * v + n * pow(mean - 5, 2) / (2 + n) AS b_n FROM s),
t AS (SELECT player, draw, unnest(range(1, {TRIES + 1})) AS turn, a_n - 1 / 3.0::DOUBLE AS d, player || ':' || draw AS base FROM (SELECT *, unnest(range(1, 6)) AS draw FROM m)),
u AS (SELECT player, draw, turn, d, {_UNIFORM.format(22)} AS v, {_UNIFORM.format(21)} AS p FROM t),
z AS (SELECT player, draw, turn, d, v, {_INVERSE_SQL} AS z FROM u), c AS (SELECT *, pow(1 + z / sqrt(9 * d), 3) AS c FROM z),
g AS (SELECT player, draw, d * c AS g FROM c WHERE c > 0 AND ln(v) < z * z / 2 + d - d * c + d * ln(greatest(c, 1e-300)) QUALIFY row_number() OVER (PARTITION BY player, draw ORDER BY turn) = 1),
w AS (SELECT m.*, draw, sqrt(b_n / g) AS sigma, CAST(m.player AS VARCHAR) AS base, draw AS turn FROM m JOIN g ON m.player = g.player),
a AS (SELECT *, {_UNIFORM.format(23)} AS p FROM w), b AS (SELECT * EXCLUDE (p), {_INVERSE_SQL} AS first FROM a), e AS (SELECT *, {_UNIFORM.format(24)} AS p FROM b), f AS (SELECT *, {_INVERSE_SQL} AS second FROM e)
SELECT player, CAST(draw AS INT) AS draw, round(sigma, 5) AS sigma, round(m_n + sigma / sqrt(k_n) * first, 5) AS mean, round(m_n + sigma / sqrt(k_n) * first + sigma * second, 5) AS points FROM f"""])


@query("ml17_posterior_draws", ML17_SQL)
def ml17_draws(spark, d):
    """Five draws of each player's deviation, mean and next season from the normal-gamma posterior of their seasons; the prior has
    two seasons of mean 5, and shape and rate 2."""
    s = season(spark, d).groupBy("player").agg(F.count("*").alias("n"), F.avg(F.col("pts") / 1e5).alias("mean"), F.var_pop(F.col("pts") / 1e5).alias("v"))
    n = F.col("n")
    m = s.select("player", (2 + n).alias("k_n"), ((10 + n * F.col("mean")) / (2 + n)).alias("m_n"), (2 + n / 2.0).alias("a_n"), (2 + 0.5 * n * F.col("v") + n * F.pow(F.col("mean") - 5, F.lit(2.0)) / (2 + n)).alias("b_n"))
    rows = m.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(5))))
    key = (F.col("player"), F.col("draw"))
    precision = gamma(F.col("a_n"), lambda k: (uniform(21, *key, k), uniform(22, *key, k)))
    rows = rows.withColumn("sigma", F.sqrt(F.col("b_n") / precision))
    mean = F.col("m_n") + F.col("sigma") / F.sqrt("k_n") * normal.inverse(uniform(23, *key))
    return rows.select("player", "draw", F.round("sigma", 5).alias("sigma"), F.round(mean, 5).alias("mean"), F.round(mean + F.col("sigma") * normal.inverse(uniform(24, *key)), 5).alias("points"))


_LINE_SQL = "covar_pop(y, a) / var_pop(a) AS p, avg(a) AS ma, avg(y) AS my"
SNK6_SQL = f"""WITH {_COV}, w AS (SELECT {_LINE_SQL} FROM x), f AS (SELECT f.fold, {_LINE_SQL} FROM (SELECT DISTINCT fold FROM x) f JOIN x ON x.fold <> f.fold GROUP BY f.fold)
SELECT player, yr, round(w.my + w.p * (a - w.ma), 5) AS predicted, round(f.my + f.p * (a - f.ma), 5) AS out_of_fold FROM x JOIN f ON x.fold = f.fold JOIN w ON true"""


@query("snk6_stored_model", SNK6_SQL)
def snk6(spark, d):
    """A pipeline of least squares and its out-of-fold rows are saved under a key, loaded again and applied to all rows."""
    x = _three(spark, d).select("player", "yr", "fold", "a", "y")
    line = LinearRegression(featuresCol="tf_f", labelCol="y", predictionCol="predicted", solver="normal")
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="tf_f"), line])
    with folder(spark) as path:
        oof = model_store.out_of_fold(x, pipeline, "fold", 5, "predicted", "out_of_fold")
        model_store.save(path, "games", pipeline.fit(x), oof.select("player", "yr", "out_of_fold"))
        model, held = model_store.load(spark, path, "games")
        out = model.transform(x).join(held, ["player", "yr"])
        return out.select("player", "yr", F.round("predicted", 5).alias("predicted"), F.round("out_of_fold", 5).alias("out_of_fold")).checkpoint()
