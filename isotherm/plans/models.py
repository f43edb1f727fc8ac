"""Queries of models on the pairs: trees, random intercepts, normality, spatial tests. Each with its SQL.

Where a model is grown or iterated, the SQL is the same iteration written out, a few named steps for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import crossval, extensions, grid, mixed, multimodel, network, pairing, ranks, regression, remap, stats, trees
from ..sources import grids as sources
from ..sources import layout, tables
from .fixtures import COARSE_LATS, COARSE_LONS, Grids
from .registry import DAY as _DAY
from .registry import ORACLE_SQL, QUERIES, _pairs, _query, _resid

# --- trees

FEATURES = ("tas", "era5_lat", "era5_lon", "day_of_year")
KEYS = ("lat_ix", "lon_ix", "day")
TRAIN_UNTIL = 1995
BOOST = {"rounds": 3, "depth": 2, "bins": 8, "rate": 0.3, "least": 20, "l2": 1.0}
FOREST = {"trees": 3, "depth": 3, "bins": 8, "each": 2, "least": 5, "seed": 42}


def _tree_rows(g: Grids) -> DataFrame:
    """Keys, target and features of the pairs, written once: edges, quantised rows and predictions read them."""
    rows = _pairs(g).select(*KEYS, "t2m", "tas", "era5_lat", "era5_lon", F.dayofyear("day").alias("day_of_year"))
    return tables.written(rows, "tree-rows")


def _trained(g: Grids) -> tuple[DataFrame, trees.Model]:
    rows = _tree_rows(g)
    return rows, trees.boosted(rows.filter(F.year("day") <= TRAIN_UNTIL), "t2m", FEATURES, **BOOST)


def _nodes(g: Grids, model: trees.Model) -> DataFrame:
    return g.fine.sparkSession.createDataFrame(model.nodes(), trees.NODES)


def _binned_sql(bins: int, known: str) -> str:
    """Steps `feat` (rows with features), `edge` and `binned`."""
    marks = "[" + ", ".join(f"{k / bins!r}::double" for k in range(1, bins)) + "]"
    columns = ("tas", "era5_lat", "era5_lon", "dayofyear(day)::double")
    values = ", ".join(f"{c} as x_{k}" for k, c in enumerate(columns))
    edges = ", ".join(f"quantile_cont(x_{k}, {marks}) as e_{k}" for k in range(len(columns)))
    bins_ = ", ".join(f"len(list_filter(e_{k}, lambda e: e < x_{k})) as b_{k}" for k in range(len(columns)))
    return f""",
feat as materialized (select lat_ix, lon_ix, day, t2m as y, {values}, {known} as known from pairs_ix),
edge as materialized (select {edges} from feat where known),
binned as materialized (select lat_ix, lon_ix, day, y, known, {bins_} from feat, edge)"""


def _grow_sql(name: str, depth: int, least: int, l2: float, allowed: str = "true") -> str:
    """Steps that grow trees on `<name>_at0` (tree, w, g, b_0, ...): `<name>_split`, `<name>_sum` and the rows' last node."""
    n = range(len(FEATURES))
    out = ""
    for level in range(depth):
        long = " union all ".join(f"select tree, node, {k} as feature, b_{k} as bin, w, g from {name}_at{level} where w > 0 and node >= {1 << level}" for k in n)
        of_bin = "case s.feature " + " ".join(f"when {k} then b_{k}" for k in n) + " end"
        term = lambda g, m: f"({g})::double * ({g})::double / (({m}) + {l2!r}::double)"
        out += f""",
{name}_h{level} as materialized (select tree, node, feature, bin, sum(w * g) as g, sum(w) as n from ({long}) group by all),
{name}_s{level} as materialized (select tree, node, feature, bin from (
  select *, {term('gl', 'nl')} + {term('gt - gl', 'nt - nl')} - {term('gt', 'nt')} as gain from (
    select *, sum(g) over (o) as gl, sum(n) over (o) as nl, sum(g) over (p) as gt, sum(n) over (p) as nt from {name}_h{level} window p as (partition by tree, node, feature), o as (partition by tree, node, feature order by bin)))
  where gain > 0 and nl >= {least} and nt - nl >= {least} and {allowed} qualify row_number() over (partition by tree, node order by gain desc, feature, bin) = 1),
{name}_at{level + 1} as materialized (select a.* exclude (node), case when s.feature is null then a.node else 2 * a.node + ({of_bin} > s.bin)::int end as node from {name}_at{level} a left join {name}_s{level} s using (tree, node))"""
    splits = " union all ".join(f"select * from {name}_s{k}" for k in range(depth))
    sums = " union all ".join(f"select tree, node, sum(w * g) as g, sum(w) as n from {name}_at{k} where w > 0 and node >= {1 << k} group by all" for k in range(depth + 1))
    return out + f""",
{name}_split as materialized ({splits}),
{name}_sum as materialized (select tree, node, g, n, g::double / (n + {l2!r}::double) / {trees.SCALE}.0::double as value from ({sums}))"""


def _nodes_sql(names: list[str]) -> str:
    every = "[" + ", ".join(f"e_{k}" for k in range(len(FEATURES))) + "]"
    name = "case s.feature " + " ".join(f"when {k} then '{f}'" for k, f in enumerate(FEATURES)) + " end"
    one = lambda k, n: f"select {f'{k}::bigint' if k is not None else 'n.tree::bigint'} as tree, n.node::bigint as node, {name} as feature, [[list_extract(list_extract((select {every} from edge), s.feature + 1), s.bin + 1)]] as threshold, n.n::bigint as n, [[n.value]] as value from {n}_sum n left join {n}_split s on s.tree = n.tree and s.node = n.node"
    return " union all ".join(one(k if len(names) > 1 else None, n) for k, n in enumerate(names))


def _boost_sql() -> str:
    units = lambda x: f"floor(({x}) * {trees.SCALE}.0::double + 0.5::double)::bigint"
    out = _binned_sql(BOOST["bins"], f"year(day) <= {TRAIN_UNTIL}")
    out += f""",
start_ as materialized (select sum({units('y')})::double / count(*) / {trees.SCALE}.0::double as base from binned where known),
p0 as materialized (select binned.*, base as p, base from binned, start_)"""
    for k in range(BOOST["rounds"]):
        out += f""",
r{k}_at0 as materialized (select * exclude (p), p as before, 0 as tree, known::int as w, {units('y - p')} as g, 1 as node from p{k})"""
        out += _grow_sql(f"r{k}", BOOST["depth"], BOOST["least"], BOOST["l2"])
        out += f""",
p{k + 1} as materialized (select lat_ix, lon_ix, day, y, known, base, {', '.join(f'b_{f}' for f in range(len(FEATURES)))}, before + {BOOST['rate']!r}::double * value as p from r{k}_at{BOOST['depth']} a join r{k}_sum s using (tree, node))"""
    return out


_SPLIT = f"case when year(day) <= {TRAIN_UNTIL} then 'train' when year(day) <= 1996 then 'validation' else 'test' end"


@_query("boosted_tree_nodes", _boost_sql() + "\n" + _nodes_sql([f"r{k}" for k in range(BOOST["rounds"])]), "pairs_ix")
def _(g, spark):
    return _nodes(g, _trained(g)[1])


@_query(
    "boosted_tree_skill",
    _boost_sql() + f"\nselect {_SPLIT} as split, count(*) as n, [[sqrt(avg(pow(y - p, 2)))]] as rmse, [[sqrt(avg(pow(y - base, 2)))]] as rmse_of_mean, [[avg(p)]] as mean_prediction from p{BOOST['rounds']} group by split",
    "pairs_ix",
)
def _(g, spark):
    rows, model = _trained(g)
    gap = lambda p: F.sqrt(F.avg(F.pow(F.col("t2m") - p, F.lit(2))))
    split = F.when(F.year("day") <= TRAIN_UNTIL, "train").when(F.year("day") <= 1996, "validation").otherwise("test")
    told = rows.select(split.alias("split"), "t2m", model.predict().alias("p"))
    return told.groupBy("split").agg(F.count("*").alias("n"), gap(F.col("p")).alias("rmse"), gap(F.lit(model.base)).alias("rmse_of_mean"), F.avg("p").alias("mean_prediction"))


def _forest_sql() -> str:
    n, seed, depth = FOREST["trees"], FOREST["seed"], FOREST["depth"]
    u = lambda t: f"('0x' || substr(md5(lat_ix || '|' || lon_ix || '|' || strftime(day, '%Y-%m-%d') || '|{seed}.{t // 4}'), {8 * (t % 4) + 1}, 8))::bigint / 4294967296.0::double"
    draw = lambda t: f"len(list_filter([{', '.join(f'{c!r}::double' for c in trees.poisson_marks())}], lambda c: {u(t)} >= c))"
    rows = " union all ".join(f"select *, {t} as tree, {draw(t)} as w, floor(y * {trees.SCALE}.0::double + 0.5::double)::bigint as g, 1 as node from binned" for t in range(n))
    choice = trees.feature_choice(seed, len(FEATURES), FOREST["each"])
    allowed = "(tree, node, feature) in (" + ", ".join(f"({t}, {node}, {f})" for t in range(n) for node in range(1, 1 << depth) for f in choice(t, node)) + ")"
    return _binned_sql(FOREST["bins"], "true") + f",\nf_at0 as materialized ({rows})" + _grow_sql("f", depth, FOREST["least"], 0.0, allowed)


def _grown(g: Grids) -> tuple[DataFrame, trees.Model]:
    rows = _tree_rows(g)
    return rows, trees.forest(rows, "t2m", FEATURES, KEYS, **FOREST)


@_query("random_forest_nodes", _forest_sql() + "\n" + _nodes_sql(["f"]), "pairs_ix")
def _(g, spark):
    return _nodes(g, _grown(g)[1])


@_query(
    "random_forest_out_of_bag",
    _forest_sql() + f"""
select count(*) as n, count(p) as n_out, [[sqrt(avg(pow(y - p, 2)))]] as rmse, [[avg(p)]] as mean_prediction from (
  select lat_ix, lon_ix, day, any_value(y) as y, avg(value) filter (w = 0) as p from f_at{FOREST['depth']} join f_sum using (tree, node) group by lat_ix, lon_ix, day)""",
    "pairs_ix",
)
def _(g, spark):
    rows, model = _grown(g)
    told = rows.select("t2m", trees.out_of_bag(model, KEYS, FOREST["seed"]).alias("p"))
    return told.agg(F.count("*").alias("n"), F.count("p").alias("n_out"), F.sqrt(F.avg(F.pow(F.col("t2m") - F.col("p"), F.lit(2)))).alias("rmse"), F.avg("p").alias("mean_prediction"))


# --- a random intercept, and normality

_OFFSET = "clat_ix * clat_ix / 16.0::double"


def _reml_sql() -> str:
    """One predictor: intercept and tas. Sums are around the means; v<k> has ratios with their score, b<k> the bracket."""
    names = [("0", "0"), ("0", "1"), ("0", "y"), ("1", "1"), ("1", "y"), ("y", "y")]
    of = {"0": "1.0::double", "1": "x", "y": "y"}
    sums = ", ".join(f"sum({of[c]}) as s_{c}" for c in of) + ", " + ", ".join(f"sum({of[a]} * {of[b]}) as q_{a}{b}" for a, b in names)
    sizes = ", ".join(f"sum(q_{a}{b}) as q_{a}{b}, sum(s_{a} * s_{b}) as p_{a}{b}" for a, b in names)
    c, d = "r / (1 + n * r)", "1 / ((1 + n * r) * (1 + n * r))"
    parts = ", ".join(f"sum(q_{a}{b} - {c} * p_{a}{b}) as a{a}{b}, sum({d} * p_{a}{b}) as d{a}{b}" for a, b in names)

    def at(name: str, grid: str) -> str:
        return f""",
{name} as materialized (
  select *, logs + ln(det) + (rows_ - 2) * ln(rss) as minus2,
    trace - (a11 * d00 - 2 * a01 * d01 + a00 * d11) / det - (rows_ - 2) / rss * (dyy - 2 * b0 * d0y - 2 * b1 * d1y + b0 * b0 * d00 + 2 * b0 * b1 * d01 + b1 * b1 * d11) as score
  from (select *, ayy - b0 * a0y - b1 * a1y as rss from (select *, (a11 * a0y - a01 * a1y) / det as b0, (a00 * a1y - a01 * a0y) / det as b1 from (
    select *, a00 * a11 - a01 * a01 as det from (
      select r, sum(cells * ln(1 + n * r)) as logs, sum(cells * n / (1 + n * r)) as trace, {parts}, (select sum(n * cells) from sizes) as rows_ from (select n::double as n, * exclude (n) from sizes), ({grid}) group by r)))))"""

    grid = ", ".join(f"({x!r}::double)" for x in mixed.GRID)
    out = f""",
raw as materialized (select clat_ix, clon_ix, tas as x, t2m + {_OFFSET} as y from pairs_ix),
mean as (select avg(x) as mx, avg(y) as my from raw),
cells as (select n, * exclude (n) from (select clat_ix, clon_ix, count(*) as n, {sums} from (select clat_ix, clon_ix, x - mx as x, y - my as y from raw, mean) group by clat_ix, clon_ix)),
sizes as materialized (select n, count(*) as cells, {sizes} from cells group by n)""" + at("v0", f"select * from (values {grid}) as t(r)")
    out += """,
best as (select r, score, row_number() over (order by r) as k from v0 qualify true),
first as (select arg_min(k, minus2) as k from best join v0 using (r)),
b0 as materialized (select (select r from best, first where best.k = greatest(1, first.k - 1)) as lo, (select r from best, first where best.k = least((select max(k) from best), first.k + 1)) as hi, (select first.k = 1 and score >= 0 from best, first where best.k = first.k) as none)"""
    for k in range(1, mixed.PASSES + 1):
        out += at(f"v{k}", f"select lo + (hi - lo) * j / {mixed.POINTS + 1}.0::double as r from b{k - 1}, (select range as j from range(1, {mixed.POINTS + 1}))")
        out += f""",
h{k} as (select coalesce((select min(r) from v{k} where score >= 0), hi) as hi, lo, none from b{k - 1}),
b{k} as materialized (select greatest(lo, coalesce((select max(r) from v{k} where r < hi), lo)) as lo, hi, none from h{k})"""
    out += at("fin", f"select case when none then 0.0::double else (lo + hi) / 2 end as r from b{mixed.PASSES}")
    return out + """
select term, [[estimate]] as estimate, [[se]] as se from (
  select unnest([{'term': 'intercept', 'estimate': my + b0 - b1 * mx, 'se': sqrt(e * (a11 + 2 * mx * a01 + mx * mx * a00) / det)}, {'term': 'tas', 'estimate': b1, 'se': sqrt(e * a00 / det)},
    {'term': 'var_cell', 'estimate': r * e, 'se': null}, {'term': 'var_error', 'estimate': e, 'se': null}, {'term': 'icc', 'estimate': r / (1 + r), 'se': null},
    {'term': 'log_likelihood', 'estimate': -0.5 * (minus2 + (rows_ - 2) * (ln(2 * pi()) + 1 - ln(rows_ - 2))), 'se': null}, {'term': 'n', 'estimate': rows_, 'se': null},
    {'term': 'n_cells', 'estimate': (select sum(cells)::double from sizes), 'se': null}], recursive := true)
  from (select *, rss / (rows_ - 2) as e from fin), mean)"""


@_query("random_intercept_reml", _reml_sql(), "pairs_ix")
def _(g, spark):
    path = tables.new_path(spark, "folded")
    folded = tables.written(pairing.folded_pairs(g.fine, g.coarse, axes=(COARSE_LATS, COARSE_LONS), spread=True).select("clat_ix", "clon_ix", "tas", "n", "mean", "spread"), "folded", path)
    rows = folded.withColumn("y", F.col("mean") + F.col("clat_ix") * F.col("clat_ix") / F.lit(16.0))
    out = mixed.random_intercept(rows, "y", {"tas": F.col("tas")}, ["clat_ix", "clon_ix"], folded=("n", "spread"))
    tables.emptied(spark, path)
    return out


def _poly_sql(x: str, c) -> str:
    return "(" + " + ".join(f"{v!r}::double" if k == 0 else f"{v!r}::double * pow({x}, {k})" for k, v in enumerate(c)) + ")"


def _quantile_sql(p: str) -> str:
    ratio = lambda x, c: f"({_poly_sql(x, c[0])} / {_poly_sql(x, c[1])})"
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    far = f"case when {r} <= 5 then {ratio(f'({r} - 1.6::double)', ranks.MIDDLE)} else {ratio(f'({r} - 5)', ranks.TAIL)} end"
    return f"case when abs({p} - 0.5) <= 0.425 then ({p} - 0.5) * {ratio(f'(0.180625::double - ({p} - 0.5) * ({p} - 0.5))', ranks.CENTRE)} when {p} < 0.5 then -({far}) else {far} end"


def _shapiro_sql(source: str) -> str:
    """W for n of 12 and more. p is left out: the query's groups are either too many for it or have it from the same formula."""
    u = "(1 / sqrt(n))"
    two = lambda c: f"2 * {c} * {c}"
    return f"""
select label, n, [[w]] as w, [[case when n <= {ranks.MOST_FOR_P} then 1 - (case when z < 0 then {_TAIL_SQL} else 1 - {_TAIL_SQL} end) end]] as p from (
 select *, abs(z) / sqrt(2.0::double) as x, 1.0::double / (1.0 + 0.3275911::double * abs(z) / sqrt(2.0::double)) as t from (
  select *, (ln(1 - w) - {_poly_sql('ln(n)', ranks.MEAN)}) / exp({_poly_sql('ln(n)', ranks.SD)}) as z from (
   select label, n, pow(al * (last - first) + an * (next - second) + (mx - ml * (last - first) - mn * (next - second)) / sqrt((mm - {two('ml')} - {two('mn')}) / (1 - {two('al')} - {two('an')})), 2) / xx as w from (
    select *, {_poly_sql(u, ranks.LAST_WEIGHT)} + ml / sqrt(mm) as al, {_poly_sql(u, ranks.NEXT_WEIGHT)} + mn / sqrt(mm) as an from (
     select label, max(n) as n, sum(m * m) as mm, sum(m * v) as mx, count(*) * var_pop(v) as xx, max(v) filter (i = 1) as first, max(v) filter (i = 2) as second, max(v) filter (i = n - 1) as next, max(v) filter (i = n) as last,
       max(m) filter (i = n - 1) as mn, max(m) filter (i = n) as ml from (select *, {_quantile_sql('q')} as m from (select *, (i - 0.375::double) / (n + 0.25::double) as q from (
         select label, v, row_number() over (partition by label order by v) as i, count(*) over (partition by label) as n from ({source})))) group by label)))))"""


_TAIL_SQL = "(((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x) / 2)"
_SAMPLES = "select 'residuals' as label, residual as v from resid union all select 'daily', avg(tas) from coarse group by day"


@_query("shapiro_wilk", _shapiro_sql(_SAMPLES), "resid", "coarse")
def _(g, spark):
    daily = stats.daily(g.coarse, "tas", "coarse")
    one = lambda df, value, label: ranks.shapiro_wilk(df, value, extensions._normal_cdf).select(F.lit(label).alias("label"), "n", "w", "p")
    return one(_resid(g), "residual", "residuals").unionByName(one(daily, "value", "daily"))


# --- several models, and the stored layout


def _models(g: Grids, spark) -> DataFrame:
    """Three models from the coarse record, as counts of days: its own grid and calendar; half the lines, moved, without leap days; the same with months of 30 days."""
    year, month, day = F.year("day"), F.month("day"), F.dayofmonth("day")
    leap = F.day(F.last_day(F.make_date(year, F.lit(2), F.lit(1)))) == 29
    of_year = F.dayofyear("day") - 1 - F.when(leap & (month > 2), 1).otherwise(0)
    half = g.coarse.filter("clat_ix % 2 = 0 and clon_ix % 2 = 0").withColumns({"clat_ix": F.expr("clat_ix div 2").cast("int"), "clon_ix": F.expr("clon_ix div 2").cast("int"), "cmip_lat": F.col("cmip_lat") + 0.3, "cmip_lon": F.col("cmip_lon") - 0.2, "tas": 0.5 * F.col("tas") + F.col("clat_ix")})
    count = lambda df, model, c: df.select(F.lit(model).alias("model"), "clat_ix", "clon_ix", "cmip_lat", "cmip_lon", c.cast("int").alias("time"), "tas")
    a = count(g.coarse, "a", F.datediff("day", F.make_date(F.lit(1992), F.lit(1), F.lit(1))))
    b = count(half, "b", (year - 1990) * 365 + of_year)
    c = count(half.filter(day <= 30), "c", (year - 1990) * 360 + (month - 1) * 30 + day - 1)
    calendars = spark.createDataFrame([("a", 1992, "standard"), ("b", 1990, "noleap"), ("c", 1990, "360_day")], "model string, start_year int, calendar string")
    return multimodel.decode_days(a.unionByName(b).unionByName(c), calendars)


_GRIDS = """,
half as (select (clat_ix / 2)::int as clat_ix, (clon_ix / 2)::int as clon_ix, cmip_lat + 0.3::double as cmip_lat, cmip_lon - 0.2::double as cmip_lon, day, 0.5::double * tas + clat_ix as tas from (
  select * from coarse where clat_ix % 2 = 0 and clon_ix % 2 = 0)),
half_lat as (select lat_ix, clat_ix from lat, (select distinct clat_ix, cmip_lat from half) qualify row_number() over (partition by lat_ix order by abs(era5_lat - cmip_lat), clat_ix) = 1),
half_lon as (select lon_ix, clon_ix from lon, (select distinct clon_ix, cmip_lon from half) qualify row_number() over (partition by lon_ix order by abs(era5_lon - cmip_lon), clon_ix) = 1),
half_pairs as materialized (select f.lat_ix, f.lon_ix, c.clat_ix, c.clon_ix, f.day, t2m, tas from fine f join half_lat using (lat_ix) join half_lon using (lon_ix) join half c on c.clat_ix = half_lat.clat_ix and c.clon_ix = half_lon.clon_ix and c.day = f.day where t2m is not null),
models as (select 'a' as model, clat_ix, clon_ix, day, t2m, tas from pairs_ix union all select 'b', clat_ix, clon_ix, day, t2m, tas from half_pairs union all select 'c', clat_ix, clon_ix, day, t2m, tas from half_pairs where day(day) <= 30)"""


@_query("models_by_grid", _GRIDS + "\nselect model, clat_ix::bigint as clat_ix, clon_ix::bigint as clon_ix, count(*) as n, count(distinct day) as n_days, [[sum(t2m)]] as t2m, [[sum(tas)]] as tas from models group by all", "pairs_ix", "lat", "lon", "coarse")
def _(g, spark):
    out = multimodel.paired(g.fine, _models(g, spark))
    return out.groupBy("model", "clat_ix", "clon_ix").agg(F.count("*").alias("n"), F.count_distinct("day").alias("n_days"), F.sum("t2m").alias("t2m"), F.sum("tas").alias("tas"))


@_query("ols_by_grid", _GRIDS + "\nselect model, [[regr_slope(t2m, tas)]] as slope, [[regr_intercept(t2m, tas)]] as intercept, [[corr(t2m, tas)]] as r, count(*) as n from models group by model", "pairs_ix", "lat", "lon", "coarse")
def _(g, spark):
    return regression.fit_folded(multimodel.folded(g.fine, _models(g, spark)), keys=["model"]).select("model", "slope", "intercept", "r", "n")


@_query("stored_pairs", "select clat_ix::bigint as clat_ix, clon_ix::bigint as clon_ix, count(*) as n, [[avg(t2m)]] as t2m, [[avg(tas)]] as tas, [[corr(t2m, tas)]] as r from pairs_ix group by clat_ix, clon_ix having count(*) > 2", "pairs_ix")
def _(g, spark):
    path = tables.new_path(spark, "layout")
    layout.store(g.fine, g.coarse, path, (COARSE_LATS, COARSE_LONS), buckets=8)
    pairs = layout.open_pairs(spark, path)
    return pairs.groupBy("clat_ix", "clon_ix").agg(F.count("*").alias("n"), F.avg("t2m").alias("t2m"), F.avg("tas").alias("tas"), F.corr("t2m", "tas").alias("r")).filter("n > 2")


# --- spherical remapping, and a spatial test

#: Target cells as uneven as can be: edges of latitudes and longitudes, the last of them past the date line.
TARGET_LATS, TARGET_LONS = (20.0, 25.5, 26.0, 31.0, 39.25, 45.0), (160.0, 170.0, 171.5, 178.0, 185.0, 190.0)
#: The coarse record is moved east by this, so that its cells lie on both sides of the date line.
MOVED = 145.0


def _axis_sql(name: str, edges: list[float], latitude: bool) -> str:
    """(ix, lo, hi), longitudes from 0 to 360."""
    rows = ", ".join(f"({k}, {a!r}::double, {b!r}::double)" for k, (a, b) in enumerate(zip(edges, edges[1:])))
    return f"{name} as (select * from (values {rows}) as t(ix, lo, hi))"


_SOURCE_LATS, _SOURCE_LONS = remap.edges_of(COARSE_LATS), [x + MOVED for x in remap.edges_of(COARSE_LONS)]


@_query(
    "spherical_remap",
    ",\n" + ", ".join([_axis_sql("sa", _SOURCE_LATS, True), _axis_sql("so", _SOURCE_LONS, False), _axis_sql("ta", list(TARGET_LATS), True), _axis_sql("to_", list(TARGET_LONS), False)])
    + f""",
wa as (select sa.ix as clat_ix, ta.ix as lat_ix, sin(radians(least(sa.hi, ta.hi))) - sin(radians(greatest(sa.lo, ta.lo))) as w from sa, ta where least(sa.hi, ta.hi) > greatest(sa.lo, ta.lo)),
wo as (select so.ix as clon_ix, to_.ix as lon_ix, least(so.hi, to_.hi) - greatest(so.lo, to_.lo) as w from so, to_ where least(so.hi, to_.hi) > greatest(so.lo, to_.lo))
select wa.lat_ix::bigint as lat_ix, wo.lon_ix::bigint as lon_ix, {_DAY}, [[sum(wa.w * wo.w * tas) / sum(wa.w * wo.w)]] as tas, [[sum(wa.w * wo.w)]] as area
from coarse join wa using (clat_ix) join wo using (clon_ix) group by wa.lat_ix, wo.lon_ix, day""",
    "coarse",
)
def _(g, spark):
    lat, lon = remap.weights(spark, (_SOURCE_LATS, _SOURCE_LONS), (TARGET_LATS, TARGET_LONS))
    return remap.remapped(g.coarse, "tas", lat, lon).select("lat_ix", "lon_ix", "day", "tas", "area")


_REPLICATES = 19


@_query(
    "morans_i_of_bias",
    f""",
field as materialized (select lat_ix, lon_ix, v - avg(v) over () as z, row_number() over (order by lat_ix, lon_ix) as id from (select clat_ix as lat_ix, clon_ix as lon_ix, avg(t2m - tas) as v from pairs_ix group by clat_ix, clon_ix)),
dealt as materialized (select 0 as r, lat_ix, lon_ix, z from field union all
  select r, lat_ix, lon_ix, f.z from (select r, lat_ix, lon_ix, row_number() over (partition by r order by md5('42|' || r || '|' || lat_ix || '|' || lon_ix), lat_ix, lon_ix) as id from field, (select range as r from range(1, {_REPLICATES + 1}))) join (select id, z from field) f using (id)),
near as (select r, lat_ix + i as lat_ix, lon_ix + j as lon_ix, z as near from dealt, (values (0, 1), (0, -1), (1, 0), (-1, 0)) as t(i, j)),
told as (select r, count(*) as links, round((select count(*) from field) * sum(z * near) / (count(*) * (select sum(z * z) from field)), 12) as i from dealt join near using (r, lat_ix, lon_ix) group by r)
select (select count(*) from field) as n, max(links) as links, [[max(i) filter (r = 0)]] as morans_i, [[count(*) filter (i >= (select i from told where r = 0)) / {_REPLICATES + 1}.0::double]] as p, [[avg(i) filter (r > 0)]] as mean_i from told""",
    "pairs_ix",
)
def _(g, spark):
    means = _pairs(g).groupBy(F.col("clat_ix").alias("lat_ix"), F.col("clon_ix").alias("lon_ix")).agg(F.avg(F.col("t2m") - F.col("tas")).alias("mean"))
    return ranks.morans_i_test(means, "mean", replicates=_REPLICATES)


# --- cross-validation, and a network

_TERMS = ("tas", "tas_before", "neighbour_gap", "sea_fraction")


def _solve_sql(n: int) -> str:
    """Steps e1 ... that eliminate the columns of m (a_i_j, i and j from 0; the last column is the right-hand side)."""
    out = ""
    for p in range(n):
        cells = ", ".join(
            (f"a_{i}_{j} / a_{p}_{p}" if i == p else f"a_{i}_{j} - a_{i}_{p} * a_{p}_{j} / a_{p}_{p}") + f" as a_{i}_{j}" for i in range(n) for j in range(p + 1, n + 1)
        )
        out += f",\ne{p + 1} as materialized (select fold, n_train, n_test, {cells} from {'m' if p == 0 else f'e{p}'})"
    return out


def _crossval_sql() -> str:
    k = len(_TERMS) + 1
    z = ["1.0::double", *(f"({t} - (select avg({t}) from known))" for t in _TERMS), "(t2m - (select avg(t2m) from known))"]
    prod = ", ".join(f"sum(z_{i} * z_{j}) as q_{i}_{j}" for i in range(k + 1) for j in range(i, k + 1))
    at = lambda i, j: f"q_{min(i, j)}_{max(i, j)}"
    rest = ", ".join(f"(select sum({at(i, j)}) from gram) - {at(i, j)} as a_{i}_{j}" for i in range(k) for j in range(k + 1))
    beta = lambda i: f"a_{i}_{k}"
    sse = f"{at(k, k)} - 2 * ({' + '.join(f'{beta(i)} * {at(i, k)}' for i in range(k))}) + " + " + ".join(f"{beta(i)} * {beta(j)} * {at(i, j)}" for i in range(k) for j in range(k))
    means = " - ".join(f"{beta(i + 1)} * (select avg({t}) from known)" for i, t in enumerate(_TERMS))
    one = lambda term, c: f"select fold, '{term}' as term, [[{c}]] as coefficient, n_train, n_test, [[rmse]] as rmse from told"
    return f""",
lagged as (select clat_ix, clon_ix, day, tas, case when lag(day) over w = day - 1 then lag(tas) over w end as tas_before from coarse window w as (partition by clat_ix, clon_ix order by day)),
around as (select a.clat_ix, a.clon_ix, a.day, avg(b.tas) as near from coarse a join coarse b on a.day = b.day and abs(a.clat_ix - b.clat_ix) + abs(a.clon_ix - b.clon_ix) = 1 group by all),
share as (select clat_ix, clon_ix, 1 - sum(is_land::int)::double / count(*) as sea_fraction from assigned group by all),
known as materialized (select year(p.day)::varchar as fold, t2m, p.tas, tas_before, near - p.tas as neighbour_gap, sea_fraction from pairs_ix p join lagged using (clat_ix, clon_ix, day) join around using (clat_ix, clon_ix, day) join share using (clat_ix, clon_ix) where tas_before is not null),
z as materialized (select fold, {', '.join(f'{c} as z_{i}' for i, c in enumerate(z))} from known),
gram as materialized (select fold, {prod} from z group by fold),
m as materialized (select fold, (select sum(q_0_0) from gram)::bigint - q_0_0::bigint as n_train, q_0_0::bigint as n_test, {rest} from gram){_solve_sql(k)}""" + _back_sql(k) + f""",
told as (select b.*, sqrt(greatest(0, {sse}) / n_test) as rmse from beta b join gram using (fold))
""" + " union all ".join([one("intercept", f"(select avg(t2m) from known) + {beta(0)} - {means}"), *(one(t, beta(i + 1)) for i, t in enumerate(_TERMS))])


def _back_sql(k: int) -> str:
    """beta: the solution, in columns a_0_k ...; elimination above and below leaves it in the last column."""
    return f",\nbeta as materialized (select fold, n_train, n_test, {', '.join(f'a_{i}_{k}' for i in range(k))} from e{k})"


@_query("blocked_cross_validation", _crossval_sql(), "pairs_ix", "coarse", "assigned")
def _(g, spark):
    near = extensions.neighbour_mean(extensions.lagged(g.coarse)).select("clat_ix", "clon_ix", "day", "tas_before", "tas_neighbours")
    sea = grid.sea_fraction(grid.assign_cells(g.pixels, COARSE_LATS, COARSE_LONS)).select("clat_ix", "clon_ix", "sea_fraction")
    rows = _pairs(g).join(near, ["clat_ix", "clon_ix", "day"]).join(sea, ["clat_ix", "clon_ix"])
    terms = {"tas": F.col("tas"), "tas_before": F.col("tas_before"), "neighbour_gap": F.col("tas_neighbours") - F.col("tas"), "sea_fraction": F.col("sea_fraction")}
    return crossval.cross_validated(rows, "t2m", terms, F.year("day"))


NET = {"units": 3, "steps": 6, "batches": 2, "rate": 0.2, "seed": 42}
_INPUTS = ("tas", "era5_lat")


def _network_sql() -> str:
    hidden, out = network.start(len(_INPUTS), NET["units"], NET["seed"])
    n, width = NET["units"], len(_INPUTS) + 1
    lit = lambda x: f"{x!r}::double"
    first = ", ".join([f"{lit(hidden[j][i])} as w_{j}_{i}" for j in range(n) for i in range(width)] + [f"{lit(out[j])} as v_{j}" for j in range(n + 1)])
    x = [*(f"x_{i}" for i in range(len(_INPUTS))), "1.0::double"]
    units = lambda c: f"sum(floor(({c}) * {network.SCALE}.0::double + 0.5::double)::bigint)::double / count(*) / {network.SCALE}.0::double"
    sql = f""",
raw as materialized (select {', '.join(f'{c} as c_{i}' for i, c in enumerate((*_INPUTS, 't2m')))}, ('0x' || substr(md5(lat_ix || '|' || lon_ix || '|' || strftime(day, '%Y-%m-%d') || '|{NET['seed']}'), 1, 8))::bigint % {NET['batches']} as batch from pairs_ix),
data as materialized (select batch, {', '.join(f'(c_{i} - (select avg(c_{i}) from raw)) / (select stddev_pop(c_{i}) from raw) as {name}' for i, name in enumerate([*(f'x_{k}' for k in range(len(_INPUTS))), 'y']))} from raw),
t0 as (select {first})"""
    for k in range(NET["steps"]):
        units_ = ", ".join(f"tanh({' + '.join([f'w_{j}_{width - 1}', *(f'w_{j}_{i} * x_{i}' for i in range(len(_INPUTS)))])}) as h_{j}" for j in range(n))
        grads = [f"{units(f'e * h_{j}')} as dv_{j}" for j in range(n)] + [f"{units('e')} as dv_{n}"] + [f"{units(f'e * v_{j} * (1 - h_{j} * h_{j}) * {x[i]}')} as dw_{j}_{i}" for j in range(n) for i in range(width)]
        sql += f""",
f{k} as materialized (select *, {' + '.join([f'v_{n}', *(f'v_{j} * h_{j}' for j in range(n))])} - y as e from (select *, {units_} from data, t{k} where batch = {k % NET['batches']})),
g{k} as materialized (select count(*) as n, {units('e * e * 0.5')} as loss, {', '.join(grads)} from f{k}),
t{k + 1} as materialized (select {', '.join([f'w_{j}_{i} - {NET["rate"]!r}::double * dw_{j}_{i} as w_{j}_{i}' for j in range(n) for i in range(width)] + [f'v_{j} - {NET["rate"]!r}::double * dv_{j} as v_{j}' for j in range(n + 1)])} from t{k}, g{k})"""
    return sql + "\n" + " union all ".join(f"select {k}::bigint as step, n, [[loss]] as loss from g{k}" for k in range(NET["steps"]))


@_query("network_losses", _network_sql(), "pairs_ix")
def _(g, spark):
    _, losses = network.train(_pairs(g), "t2m", _INPUTS, KEYS, **NET)
    return spark.createDataFrame(losses, "step long, n long, loss double")


# --- orders


@_query("time_order", f"select row_number() over (order by day) - 1 as pos, {_DAY} from (select distinct day from fine)", "fine")
def _(g, spark):
    return grid.axis_order(g.fine, "day")


@_query("longitude_order", "select row_number() over (order by x) - 1 as pos, [[x]] as lon from (select case when (select max(era5_lon * 5) from lon) > 180 then (era5_lon * 5 + 180.0) % 360.0 - 180.0 else era5_lon * 5 end as x from lon)", "lon")
def _(g, spark):
    return grid.axis_order(grid.standardize_longitude(g.lons.select((F.col("era5_lon") * 5).alias("lon")), "lon"), "lon")


def _file_order(spark, sf_dir: str) -> DataFrame:
    """Files of a folder by name, a file for each nation."""
    folder = tables.new_path(spark, "files")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("k"), "n_name")
    nations.coalesce(1).write.partitionBy("k").text(folder)
    found = sources.list_files(spark, folder, "part-*.txt", exclude="")
    return grid.axis_order(found.withColumn("name", F.regexp_extract("path", "(k=[0-9]+)", 1)), "name").withColumn("pos", F.col("pos").cast("long"))


QUERIES["file_order"] = _file_order
ORACLE_SQL["file_order"] = "select row_number() over (order by 'k=' || n_nationkey) - 1 as pos, 'k=' || n_nationkey as name from nation"
