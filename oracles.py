"""SQL of the checks: what each registered query must return, for an engine without Spark.

Every function returns plain SQL over the test tables. Doubles are rounded on both sides; adding 0.0
turns a rounded minus zero into zero.
"""

from __future__ import annotations

import math

SEED = 42
PRIME = (1 << 31) - 1
LINE_KEY = ["l_orderkey", "l_linenumber", "l_suppkey"]
LINE_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def text_hash(parts, digits, start=1):
    words = " || '|' || ".join(f"coalesce(cast({p} AS VARCHAR), 'null')" for p in parts)
    return f"('0x' || substr(md5('{SEED}' || '|' || {words}), {start}, {digits}))::BIGINT"


def uniform(*parts):
    return f"({text_hash(parts, 13)}::DOUBLE / 4503599627370496.0)"


def rounded(expression, places):
    return f"round({expression}, {places}) + 0.0"


def listed(p, pattern, sep=", "):
    return sep.join(pattern.format(i=i) for i in range(p))


def observations(source, key, target, features, row_key, carry=()):
    """Rows with key columns k0.., features x0.., target y, order hash h and the validation flag."""
    p, m = len(features), len(key)
    keys = ", ".join(f"{k} AS k{i}" for i, k in enumerate(key))
    xs = ", ".join(f"coalesce(CAST({f} AS DOUBLE), 0.0) AS x{i}" for i, f in enumerate(features))
    extra = "".join(f", {c}" for c in carry)
    group = listed(m, "k{i}")
    order = "h, " + listed(p, "x{i}") + ", y NULLS FIRST"
    return f"""raw AS (SELECT {keys}, {xs}, CAST({target} AS DOUBLE) AS y, {text_hash(row_key, 15)} AS h{extra} FROM {source}),
obs AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order})
  <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY {group})) AS held FROM raw)"""


def linear_fit(p, m, min_rows=10, alpha=None):
    """Coefficients w0.. and intercept b per key, by Cramer's rule on centred moments of the training rows."""
    fit = "FILTER (WHERE NOT held)"
    group = listed(m, "k{i}")
    means = listed(p, f"avg(x{{i}}) {fit} AS m{{i}}")
    moments = ", ".join(f"covar_pop(x{i}, x{j}) {fit} AS c{i}{j}" for i in range(p) for j in range(i, p))
    cross = listed(p, f"covar_pop(x{{i}}, y) {fit} AS g{{i}}")
    stats = f"""stats AS (SELECT {group}, count(*) AS n, count(*) {fit} AS nf, count(*) FILTER (WHERE y IS NULL) AS lost,
  {means}, avg(y) {fit} AS my, {moments}, {cross} FROM obs GROUP BY {group})"""
    source, ridge = "stats", "0.0"
    if alpha is not None:
        source, ridge = "planned", "alpha / nf"

    def c(i, j):
        a, b = min(i, j), max(i, j)
        return f"(c{a}{b} + {ridge})" if a == b else f"c{a}{b}"

    def det(columns):
        (a, b, d), (e, f, g), (h, i, j) = zip(*columns)
        return f"({a} * ({f} * {j} - {g} * {i}) - {b} * ({e} * {j} - {g} * {h}) + {d} * ({e} * {i} - {f} * {h}))"

    if p == 1:
        slopes = f"CASE WHEN {c(0, 0)} > 1e-12 * m0 * m0 THEN g0 / {c(0, 0)} END AS w0"
    else:
        matrix = [[c(i, j) for i in range(3)] for j in range(3)]
        right = ["g0", "g1", "g2"]
        swapped = [[right if j == k else matrix[j] for j in range(3)] for k in range(3)]
        slopes = ", ".join(f"{det(s)} / {det(matrix)} AS w{k}" for k, s in enumerate(swapped))
    solved = f"solved AS (SELECT *, {slopes} FROM {source})"
    dot = listed(p, "w{i} * m{i}", " + ")
    status = f"CASE WHEN n < {min_rows} THEN 'insufficient_data' WHEN lost > 0 THEN 'error: missing target' " + (
        "WHEN w0 IS NULL THEN 'error: singular matrix' ELSE 'success' END"
    )
    fits = f"fits AS (SELECT *, my - ({dot}) AS b, {status} AS status FROM solved)"
    return stats, f"{solved},\n{fits}"


def linear_models(p, m, min_rows=10, alpha=None):
    """One row per key: n, status, rmse, mse, mae, b and w0..; null where there is no model."""
    stats, fits = linear_fit(p, m, min_rows, alpha)
    if alpha is not None:
        stats += f",\nplanned AS (SELECT *, {alpha}::DOUBLE AS alpha FROM stats)"
    group = listed(m, "k{i}")
    on = listed(m, "f.k{i} IS NOT DISTINCT FROM o.k{i}", " AND ")
    predicted = "f.b + " + listed(p, "f.w{i} * o.x{i}", " + ")
    good = "CASE WHEN any_value(f.status) = 'success' THEN {} END"
    err = f"(o.y - ({predicted}))"
    columns = [
        "any_value(f.n) AS n",
        "any_value(f.status) AS status",
        good.format(f"sqrt(avg({err} * {err}))") + " AS rmse",
        good.format(f"avg({err} * {err})") + " AS mse",
        good.format(f"avg(abs({err}))") + " AS mae",
        good.format("any_value(f.b)") + " AS b",
        *[good.format(f"any_value(f.w{i})") + f" AS w{i}" for i in range(p)],
    ]
    keys = listed(m, "f.k{i} AS k{i}")
    models = f"""models AS (SELECT {keys}, {', '.join(columns)} FROM fits f JOIN obs o ON {on} AND o.held GROUP BY {listed(m, 'f.k{i}')})"""
    return f"{stats},\n{fits},\n{models}", group


def model_listing(key, features, places=4):
    names = ", ".join(f"k{i} AS {k}" for i, k in enumerate(key))
    weights = "".join(f", {rounded(f'w{i}', places)} AS w{i}" for i in range(len(features)))
    return f"""SELECT {names}, n AS num_rows, status, {rounded('rmse', 2)} AS rmse, {rounded('mse', 0)} AS mse,
  {rounded('mae', 5)} AS mae, {rounded('b', 2)} AS intercept{weights} FROM models"""


def train_linear(source, key, target, features, row_key, min_rows=10):
    models, _ = linear_models(len(features), len(key), min_rows)
    return f"WITH {observations(source, key, target, features, row_key)},\n{models}\n{model_listing(key, features)}"


def linear_ctes(source, key, target, features, row_key, carry=()):
    models, _ = linear_models(len(features), len(key))
    return f"WITH {observations(source, key, target, features, row_key, carry)},\n{models}"


def trial_draws(space, label, source, trials):
    """Plan rows: the drawn value of every parameter for trials 0..; ``space`` lists (name, low, high) or (name, values)."""
    columns = []
    for name, *rest in space:
        u = uniform(label, "trial", f"'{name}'")
        if len(rest) == 2:
            columns.append(f"({rest[0]} + floor({u} * {rest[1] - rest[0] + 1}.0))::BIGINT AS {name}")
        else:
            values = ", ".join("NULL" if v is None else repr(v) for v in rest[0])
            kind = "DOUBLE" if any(isinstance(v, float) for v in rest[0]) else "BIGINT"
            columns.append(f"([{values}]::{kind}[])[floor({u} * {len(rest[0])}.0)::INTEGER + 1] AS {name}")
    return f"SELECT *, {', '.join(columns)} FROM {source} CROSS JOIN (SELECT unnest(range({trials})) AS trial)"


def wide(total):
    """A whole number as a double, by halves of 26 bits."""
    return f"(({total} // 67108864)::DOUBLE * 67108864.0::DOUBLE + ({total} % 67108864)::DOUBLE)"


def forest(source, key, target, features, row_key, trees, score_all=False, carry=(), space=None, trials=1):
    """CTEs up to ``votes``: per key, trial and scored row the sum and number of tree predictions.

    ``space`` draws limits per key and trial; without it every key has one trial of ``trees`` full trees.
    """
    p, m = len(features), len(key)
    ks, rk = listed(m, "k{i}"), listed(m, "r.k{i}")
    xs, bs = listed(p, "x{i}"), listed(p, "b{i}")
    cuts = [math.floor(PRIME * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(13)]
    weight = " + ".join(f"(u >= {c})::BIGINT" for c in cuts)
    ranks = ", ".join(
        f"dense_rank() OVER (PARTITION BY {ks} ORDER BY x{i}) - 1 AS b{i}"
        for i in range(p)
    )
    edges = " UNION ALL ".join(
        f"SELECT {ks}, {i} AS f, b{i} AS b, min(x{i}) AS least, max(x{i}) AS most FROM fit GROUP BY {ks}, b{i}"
        for i in range(p)
    )
    digest = f"md5('{SEED}|tree|' || t)"
    if space is None:
        plan = f"SELECT DISTINCT {ks}, 0 AS trial, {trees} AS n_estimators, NULL::BIGINT AS max_depth, 2 AS min_samples_split, 1 AS min_samples_leaf FROM fit"
    else:
        plan = trial_draws(space, "k0", f"(SELECT DISTINCT {ks} FROM fit)", trials)
    unit = f"{ks}, trial, t"
    bars = " UNION ALL ".join(
        f"SELECT {unit}, node, {i} AS f, b{i} AS b, w, q, dl, sl, ll, lev FROM walk WHERE w > 0" for i in range(p)
    )
    part = f"PARTITION BY {unit}, node, f"
    chosen = " ".join(f"WHEN {i} THEN r.x{i}" for i in range(p))
    on_unit = listed(m, "r.k{i} = c.k{i}", " AND ") + " AND r.trial = c.trial AND r.t = c.t AND r.node = c.node"
    on_key = listed(m, "a.k{i} = z.k{i}", " AND ")
    scored = "obs" if score_all else "(SELECT * FROM obs WHERE held)"
    extra = "".join(f", {c}" for c in carry)
    numbered = observations(source, key, target, features, row_key, carry)
    return f"""WITH RECURSIVE {numbered},
sizes AS (SELECT {ks}, count(*) AS n, min(y) FILTER (WHERE NOT held) AS lo, max(y) FILTER (WHERE NOT held) AS hi FROM obs GROUP BY {ks}),
fit AS (SELECT obs.*, lo, hi, floor((y - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END) * 4503599627370496.0 + 0.5)::BIGINT AS q, {ranks}
  FROM obs JOIN sizes USING ({ks}) WHERE NOT held AND n >= 10),
edges AS MATERIALIZED ({edges}),
trees AS (SELECT t, 1 + ('0x' || substr({digest}, 1, 8))::BIGINT % {PRIME - 1} AS ta, ('0x' || substr({digest}, 9, 8))::BIGINT % {PRIME} AS tb
  FROM (SELECT unnest(range({trees})) AS t)),
plan AS MATERIALIZED ({plan}),
drawn AS (SELECT * REPLACE (CASE WHEN max(w) OVER (PARTITION BY {ks}, t) = 0 THEN 1::BIGINT ELSE w END AS w) FROM (
  SELECT *, {weight} AS w FROM (SELECT {ks}, t, {xs}, {bs}, q, (ta * (h % {PRIME}) + tb) % {PRIME} AS u FROM fit CROSS JOIN trees))),
scored AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM {scored}),
walk AS (
  SELECT 0 AS lev, {ks}, trial, t, 0::BIGINT AS node, 0::BIGINT AS rid, w, q, {xs}, {bs},
    max_depth AS dl, min_samples_split AS sl, min_samples_leaf AS ll
  FROM drawn JOIN plan USING ({ks}) WHERE w > 0 AND t < n_estimators
  UNION ALL
  SELECT 0, {ks}, trial, t, 0, rid, 0, NULL, {xs}, {listed(p, 'NULL')}, NULL, NULL, NULL
  FROM scored JOIN plan USING ({ks}) CROSS JOIN trees WHERE t < n_estimators
  UNION ALL
  SELECT * FROM (WITH bars AS (SELECT {unit}, node, f, b, count(*) AS c, sum(w)::BIGINT AS w, sum(w * q)::HUGEINT AS s, min(q) AS least, max(q) AS most,
      any_value(dl) AS dl, any_value(sl) AS sl, any_value(ll) AS ll, any_value(lev) AS lev FROM ({bars}) GROUP BY {unit}, node, f, b),
    sums AS (SELECT {unit}, node, f, b, dl, sl, ll, lev, lead(b) OVER ({part} ORDER BY b) AS nextb,
      sum(c) OVER ({part} ORDER BY b) AS cl, (sum(w) OVER ({part} ORDER BY b))::BIGINT AS wl, (sum(s) OVER ({part} ORDER BY b))::HUGEINT AS sleft,
      sum(c) OVER ({part}) AS ca, (sum(w) OVER ({part}))::BIGINT AS wa, (sum(s) OVER ({part}))::HUGEINT AS sa,
      min(least) OVER ({part}) AS least, max(most) OVER ({part}) AS most FROM bars),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY {unit}, node ORDER BY
        {wide('sleft')} * {wide('sleft')} / wl + {wide('(sa - sleft)')} * {wide('(sa - sleft)')} / (wa - wl) DESC, f, b) AS place
      FROM sums WHERE nextb IS NOT NULL AND least < most AND ca >= sl AND cl >= ll AND ca - cl >= ll AND (dl IS NULL OR lev < dl)),
    cut AS (SELECT {listed(m, 'a.k{i}')}, a.trial, a.t, a.node, a.f,
        CASE WHEN e.most + (g.least - e.most) / 2 >= g.least THEN e.most ELSE e.most + (g.least - e.most) / 2 END AS thr
      FROM ranked a JOIN edges e ON {listed(m, 'a.k{i} = e.k{i}', ' AND ')} AND a.f = e.f AND a.b = e.b
      JOIN edges g ON {listed(m, 'a.k{i} = g.k{i}', ' AND ')} AND a.f = g.f AND a.nextb = g.b WHERE place = 1)
    SELECT r.lev + 1, {rk}, r.trial, r.t, 2 * r.node + CASE WHEN CASE c.f {chosen} END > c.thr THEN 2 ELSE 1 END, r.rid, r.w, r.q,
      {listed(p, 'r.x{i}')}, {listed(p, 'r.b{i}')}, r.dl, r.sl, r.ll FROM walk r JOIN cut c ON {on_unit})),
leaves AS (SELECT {unit}, node, {wide('sum(w * q)')} / sum(w)::BIGINT::DOUBLE AS mean FROM walk WHERE w > 0 GROUP BY {unit}, node),
ends AS (SELECT {unit}, rid, max(node) AS node FROM walk WHERE rid > 0 GROUP BY {unit}, rid),
votes AS (SELECT {listed(m, 'a.k{i}')}, a.trial, a.rid, avg(a.mean / 4503599627370496.0 * (z.hi - z.lo) + z.lo) AS prediction
  FROM (SELECT * FROM ends JOIN leaves USING ({unit}, node)) a JOIN sizes z ON {on_key} GROUP BY {listed(m, 'a.k{i}')}, a.trial, a.rid)"""


def train_ridge(source, key, target, features, row_key, alpha):
    models, _ = linear_models(len(features), len(key), alpha=alpha)
    return f"WITH {observations(source, key, target, features, row_key)},\n{models}\n{model_listing(key, features)}"


def forest_models(key, **arguments):
    """One row per key with the hold-out error of its forest."""
    m = len(key)
    ks = listed(m, "k{i}")
    names = ", ".join(f"z.k{i} AS {k}" for i, k in enumerate(key))
    on = listed(m, "z.k{i} = e.k{i}", " AND ")
    return f"""{forest(key=key, **arguments)},
errors AS (SELECT {ks}, avg((y - prediction) * (y - prediction)) AS mse, avg(abs(y - prediction)) AS mae
  FROM votes JOIN scored USING ({ks}, rid) GROUP BY {ks})
SELECT {names}, z.n AS num_rows, CASE WHEN z.n < 10 THEN 'insufficient_data' ELSE 'success' END AS status,
  {rounded('sqrt(mse)', 2)} AS rmse, {rounded('mse', 0)} AS mse, {rounded('mae + 3.7e-8', 5)} AS mae
FROM sizes z LEFT JOIN errors e ON {on}"""


def ridge_trials(source, key, target, features, row_key, alphas, trials):
    """CTEs up to ``tried``: the validation error of every (key, trial), measured row by row."""
    p, m = len(features), len(key)
    stats, fits = linear_fit(p, m, alpha=True)
    plan = trial_draws([("alpha", alphas)], "k0", "stats", trials)
    on = listed(m, "f.k{i} = o.k{i}", " AND ")
    err = "(o.y - (f.b + " + listed(p, "f.w{i} * o.x{i}", " + ") + "))"
    group = listed(m, "f.k{i}")
    return f"""WITH {observations(source, key, target, features, row_key)},
{stats},
planned AS ({plan}),
{fits},
tried AS (SELECT {group}, f.trial, any_value(f.alpha) AS alpha, any_value(f.n) AS n, any_value(f.b) AS b,
  {listed(p, 'any_value(f.w{i}) AS w{i}')}, avg({err} * {err}) AS mse, avg(abs{err}) AS mae
  FROM fits f JOIN obs o ON {on} AND o.held GROUP BY {group}, f.trial)"""


def guided_proposals(forest_ctes, key, space, trial):
    """The next trial of each key from its trials so far, the one best of them being the good share."""
    codes, sides, tries, scores, chosen = [], [], [], [], []
    for name, *rest in space:
        whole = len(rest) == 2
        low, high = (rest[0], rest[1]) if whole else (0, len(rest[0]) - 1)
        width = f"{high - low + 1}.0::DOUBLE"
        if whole:
            code = f"{name}::DOUBLE"
        else:
            options = " ".join(f"WHEN {name} IS NOT DISTINCT FROM {'NULL' if v is None else v} THEN {i}" for i, v in enumerate(rest[0]))
            code = f"(CASE {options} END)::DOUBLE"
        codes.append(f"{code} AS c_{name}")
        for side, condition in (("g", "good"), ("r", "NOT good")):
            sides.append(f"list(c_{name} ORDER BY c_{name}) FILTER (WHERE {condition}) AS {side}_{name}")
        draw = ["k0", str(trial), f"'{name}'", "i"]
        centre = f"g_{name}[floor({uniform(*draw, chr(39) + 'pick' + chr(39))} * (len(g_{name}) + 1.0))::INTEGER + 1]"
        anywhere = f"{low}.0::DOUBLE + floor({uniform(*draw, chr(39) + 'any' + chr(39))} * {width})"
        near = centre
        if whole:
            step = [*draw, "'step'"]
            radius, angle = uniform(*step, "'r'"), uniform(*step, "'a'")
            z = f"(sqrt(-2.0 * ln(1.0 - {radius})) * cos(6.283185307179586 * {angle}))"
            near = f"greatest({low}.0, least({high}.0, round({centre} + {width} / least(100.0, len(g_{name}) + 1.0) * {z})))"
        tries.append(f"CASE WHEN {centre} IS NOT NULL THEN {near} ELSE {anywhere} END AS v_{name}")

        def density(side):
            seen = f"{side}_{name}"
            if whole:
                h = f"({width} / least(100.0, len({seen}) + 1.0))"
                bumps = f"list_sum([exp(-(v_{name} - s) * (v_{name} - s) / (2.0 * {h} * {h})) / ({h} * 2.5066282746310002) for s in {seen}])"
                return f"((1.0 / {width} + {bumps}) / (len({seen}) + 1.0))"
            return f"((len([s for s in {seen} if s = v_{name}]) + 1.0 / {width}) / (len({seen}) + 1.0))"

        scores.append(f"{density('g')} / {density('r')} AS q_{name}")
        best = f"first(v_{name} ORDER BY q_{name} DESC, i)"
        if whole:
            chosen.append(f"{best}::BIGINT AS {name}")
        else:
            text = any(v is None for v in rest[0])
            values = ", ".join("'unlimited'" if v is None else f"'{v}'" if text else str(v) for v in rest[0])
            chosen.append(f"([{values}])[{best}::INTEGER + 1]{'' if text else '::BIGINT'} AS {name}")
    return f"""{forest_ctes},
errors AS (SELECT k0, trial, {rounded('sqrt(avg((y - prediction) * (y - prediction)))', 2)} AS rmse
  FROM votes JOIN scored USING (k0, rid) GROUP BY k0, trial),
ranked AS (SELECT k0, {', '.join(codes)}, row_number() OVER (PARTITION BY k0 ORDER BY rmse, trial) = 1 AS good
  FROM errors JOIN plan USING (k0, trial)),
sides AS (SELECT k0, {', '.join(sides)} FROM ranked GROUP BY k0),
tries AS (SELECT *, {', '.join(tries)} FROM (SELECT *, unnest(range(24)) AS i FROM sides)),
judged AS (SELECT *, {', '.join(scores)} FROM tries)
SELECT k0 AS {key}, {trial}::BIGINT AS trial, {', '.join(chosen)} FROM judged GROUP BY k0"""
