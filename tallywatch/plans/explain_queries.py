"""Explanation queries on customers and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywatch.operators import explain as E
from tallywatch.operators import scoring
from tallywatch.operators import trees as T
from tallywatch.plans.bindings import query, read, rounded
from tallywatch.plans.table_queries import ATTR_SQL, attributions
from tallywatch.session import materialise

FEATURES = ("bal", "nat", "seg")
WEIGHTS = {"bal": 0.0003, "nat": -0.08, "seg": 0.2}
BIAS = -1.5
CUST = """cust AS (SELECT c_custkey, c_acctbal AS bal, c_nationkey::DOUBLE AS nat, length(c_mktsegment)::DOUBLE AS seg, (c_acctbal + 100 * c_nationkey > 5000)::INTEGER AS y FROM customer)"""


def customers(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(
        "c_custkey",
        F.col("c_acctbal").alias("bal"),
        F.col("c_nationkey").cast("double").alias("nat"),
        F.length("c_mktsegment").cast("double").alias("seg"),
        (F.col("c_acctbal") + 100 * F.col("c_nationkey") > 5000).cast("int").alias("y"),
    )


LOGIT = scoring.logistic_scorer(WEIGHTS, BIAS)
MIXED = scoring.ColumnScorer(lambda x: 0.0001 * x["bal"] * x["nat"] + 0.1 * x["seg"])


def f(b="bal", n="nat", s="seg") -> str:
    """The logistic scorer in SQL."""
    return f"(1.0::DOUBLE / (1.0 + exp(-(-1.5::DOUBLE + ({b}) * 0.0003::DOUBLE + ({n}) * -0.08::DOUBLE + ({s}) * 0.2::DOUBLE))))"


def g(b="bal", n="nat", s="seg") -> str:
    return f"(0.0001::DOUBLE * ({b}) * ({n}) + 0.1::DOUBLE * ({s}))"


@query("exp_score", f"WITH {CUST} SELECT c_custkey, round({f()}, 6) AS score FROM cust")
def _score(spark, sf_dir):
    return rounded(scoring.score(customers(spark, sf_dir), LOGIT, FEATURES).select("c_custkey", "score"))


@query("exp_score_batches", f"WITH {CUST} SELECT c_custkey, round({f()}, 6) AS score FROM cust")
def _score_batches(spark, sf_dir):
    def model(frame):
        import numpy as np

        return 1 / (1 + np.exp(-(-1.5 + frame["bal"] * 0.0003 - frame["nat"] * 0.08 + frame["seg"] * 0.2)))

    return rounded(scoring.score(customers(spark, sf_dir), scoring.BatchScorer(model, FEATURES), FEATURES).select("c_custkey", "score"))


@query("exp_evaluate", f"""WITH {CUST}, p AS (SELECT y, ({f()} >= 0.5)::INTEGER AS p FROM cust) SELECT count(*) AS n, round(avg((y = p)::INTEGER), 6) AS accuracy FROM p""")
def _evaluate(spark, sf_dir):
    return rounded(scoring.evaluate(customers(spark, sf_dir), LOGIT, FEATURES, "y").select("n", "accuracy"))


def _permuted(repeats: int) -> str:
    """Row by row the values of the s-th successor in hash order, for s from 1 to ``repeats``."""
    return f"""WITH {CUST}, o AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || c_custkey)) - 1 AS i, count(*) OVER () AS n FROM cust),
   mv AS (SELECT o.*, s, o2.bal AS b2, o2.nat AS n2, o2.seg AS s2 FROM o, (SELECT unnest(range(1, {repeats + 1})) AS s) JOIN o AS o2 ON o2.i = (o.i + s) % o.n),
   ac AS (SELECT s, avg((({f()} >= 0.5) = (y = 1))::INTEGER) AS base, avg((({f("b2")} >= 0.5) = (y = 1))::INTEGER) AS bal, avg((({f(n="n2")} >= 0.5) = (y = 1))::INTEGER) AS nat, avg((({f(s="s2")} >= 0.5) = (y = 1))::INTEGER) AS seg FROM mv GROUP BY s)
   SELECT 'bal' AS feature, round(avg(base - bal), 6) AS importance, round(stddev_pop(base - bal), 6) AS spread FROM ac UNION ALL SELECT 'nat', round(avg(base - nat), 6), round(stddev_pop(base - nat), 6) FROM ac
   UNION ALL SELECT 'seg', round(avg(base - seg), 6), round(stddev_pop(base - seg), 6) FROM ac"""


@query("exp_permutation_importance", f"""WITH {CUST}, rep AS (SELECT cust.*, r AS repeat, md5('42|' || r || '|' || c_custkey) AS h FROM cust, (SELECT unnest(range(0, 10)) AS r)),
   mv AS (SELECT *, coalesce(lead(bal) OVER w, first(bal) OVER w) AS b2, coalesce(lead(nat) OVER w, first(nat) OVER w) AS n2, coalesce(lead(seg) OVER w, first(seg) OVER w) AS s2 FROM rep WINDOW w AS (PARTITION BY repeat ORDER BY h)),
   ac AS (SELECT repeat, avg((({f()} >= 0.5) = (y = 1))::INTEGER) AS base, avg((({f("b2")} >= 0.5) = (y = 1))::INTEGER) AS bal, avg((({f(n="n2")} >= 0.5) = (y = 1))::INTEGER) AS nat, avg((({f(s="s2")} >= 0.5) = (y = 1))::INTEGER) AS seg FROM mv GROUP BY repeat)
   SELECT 'bal' AS feature, round(avg(base - bal), 6) AS importance, round(stddev_pop(base - bal), 6) AS spread FROM ac UNION ALL SELECT 'nat', round(avg(base - nat), 6), round(stddev_pop(base - nat), 6) FROM ac
   UNION ALL SELECT 'seg', round(avg(base - seg), 6), round(stddev_pop(base - seg), 6) FROM ac""")
def _permutation(spark, sf_dir):
    return rounded(E.permutation_importance(customers(spark, sf_dir), "c_custkey", FEATURES, "y", LOGIT))


@query("exp_drop_column_importance", _permuted(3))
def _drop_column(spark, sf_dir):
    return rounded(E.drop_column_importance(customers(spark, sf_dir), "c_custkey", FEATURES, "y", LOGIT, repeats=3))


@query("exp_shap_linear", f"""WITH {CUST}, m AS (SELECT avg(bal) AS b, avg(nat) AS n FROM cust) SELECT c_custkey, 'bal' AS feature, bal AS value, round(0.0003::DOUBLE * (bal - b), 6) AS attribution FROM cust, m
   UNION ALL SELECT c_custkey, 'nat', nat, round(-0.08::DOUBLE * (nat - n), 6) FROM cust, m""")
def _shap_linear(spark, sf_dir):
    return rounded(E.shap_linear(customers(spark, sf_dir), "c_custkey", {"bal": 0.0003, "nat": -0.08}))


BG = "bg AS (SELECT bal AS bb, nat AS bn, seg AS bs FROM cust ORDER BY md5('42|' || c_custkey) LIMIT 20)"


def _coalitions() -> str:
    """v(S) for all eight coalitions of three features."""
    cells = []
    for mask in range(8):
        names = ["bal" if mask & 1 else "bb", "nat" if mask & 2 else "bn", "seg" if mask & 4 else "bs"]
        cells.append(f"avg({f(*names)}) AS v{mask}")
    return f"co AS (SELECT c_custkey, {', '.join(cells)} FROM cust, bg GROUP BY c_custkey)"


def _phi(j: int) -> str:
    bit, others = 1 << j, [1 << k for k in range(3) if k != j]
    a, b = others
    return f"(v{bit} - v0) / 3 + (v{bit | a} - v{a}) / 6 + (v{bit | b} - v{b}) / 6 + (v7 - v{a | b}) / 3"


@query("exp_shap_kernel", f"WITH {CUST}, {BG}, {_coalitions()} " + " UNION ALL ".join(
    f"SELECT c_custkey, '{n}' AS feature, round({_phi(j)}, 6) AS attribution, round(v0, 6) AS base, round(v7, 6) AS prediction FROM co" for j, n in enumerate(FEATURES)))
def _shap_kernel(spark, sf_dir):
    rows = customers(spark, sf_dir)
    background = E.background_rows(rows, "c_custkey", FEATURES)
    return rounded(E.shap_kernel(rows, "c_custkey", FEATURES, LOGIT, background))


@query("exp_shap_interactions", f"WITH {CUST}, {BG}, {_coalitions()} SELECT 'bal' AS feature_i, 'nat' AS feature_j, round(avg(abs((v3 - v1 - v2 + v0) / 4 + (v7 - v5 - v6 + v4) / 4)), 6) AS strength FROM co"
       " UNION ALL SELECT 'bal', 'seg', round(avg(abs((v5 - v1 - v4 + v0) / 4 + (v7 - v3 - v6 + v2) / 4)), 6) FROM co UNION ALL SELECT 'nat', 'seg', round(avg(abs((v6 - v2 - v4 + v0) / 4 + (v7 - v3 - v5 + v1) / 4)), 6) FROM co")
def _shap_interactions(spark, sf_dir):
    rows = customers(spark, sf_dir)
    return rounded(E.shap_interactions(rows, "c_custkey", FEATURES, LOGIT, E.background_rows(rows, "c_custkey", FEATURES)))


@query("exp_lime_tabular")
def _lime(spark, sf_dir):
    return rounded(E.lime_tabular(customers(spark, sf_dir), "c_custkey", FEATURES, LOGIT, num_samples=200), 4)


@query("exp_global_importance", f"""WITH {ATTR_SQL}, s AS (SELECT feature, avg(abs(attribution)) AS importance, max(attribution) AS mx, min(attribution) AS mn FROM attr GROUP BY feature)
   SELECT feature, round(importance, 6) AS importance, round(mx, 6) AS max_attribution, round(mn, 6) AS min_attribution, row_number() OVER (ORDER BY importance DESC, feature)::INTEGER AS rank FROM s""")
def _global(spark, sf_dir):
    return rounded(E.global_importance(attributions(spark, sf_dir)))


@query("exp_importance_details", f"""WITH {ATTR_SQL}, s AS (SELECT feature, avg(abs(attribution)) AS importance FROM attr GROUP BY feature)
   SELECT feature, round(importance, 6) AS importance, row_number() OVER (ORDER BY importance DESC, feature)::INTEGER AS rank, round(avg(importance) OVER (), 6) AS mean_importance, round(stddev_pop(importance) OVER (), 6) AS std_importance,
   round(max(importance) OVER (), 6) AS max_importance, round(min(importance) OVER (), 6) AS min_importance, round(importance / avg(importance) OVER (), 6) AS relative_importance,
   round(importance - 0.1 * stddev_pop(importance) OVER (), 6) AS low, round(importance + 0.1 * stddev_pop(importance) OVER (), 6) AS high FROM s""")
def _details(spark, sf_dir):
    rows = E.global_importance(attributions(spark, sf_dir)).select("feature", "importance")
    return rounded(E.importance_details(rows))


def _mi_sql(name: str) -> str:
    return f"""SELECT '{name}' AS feature, round(sum(n / t::DOUBLE * ln(n::DOUBLE * t / (b::DOUBLE * l))), 6) AS mutual_information FROM (SELECT bin, y, count(*) AS n, sum(count(*)) OVER (PARTITION BY bin) AS b,
      sum(count(*)) OVER (PARTITION BY y) AS l, sum(count(*)) OVER () AS t FROM (SELECT y, least(floor(({name} - lo) / ((hi - lo) / 10.0::DOUBLE)), 9) AS bin FROM cust, (SELECT min({name}) AS lo, max({name}) AS hi FROM cust)) GROUP BY bin, y)"""


@query("exp_mutual_information", f"WITH {CUST} " + " UNION ALL ".join(_mi_sql(n) for n in FEATURES))
def _mi(spark, sf_dir):
    return rounded(E.mutual_information(customers(spark, sf_dir), FEATURES, "y"))


INTER = f"""WITH {CUST}, o AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || c_custkey)) - 1 AS i, count(*) OVER () AS n FROM cust),
   q AS (SELECT o.*, ob.bal AS b2, oc.nat AS n2, od.seg AS s2 FROM o JOIN o AS ob ON ob.i = (o.i + 1) % o.n JOIN o AS oc ON oc.i = (o.i + 2) % o.n JOIN o AS od ON od.i = (o.i + 3) % o.n),
   a AS (SELECT avg(abs({g()} - {g("b2")})) AS db, avg(abs({g()} - {g(n="n2")})) AS dn, avg(abs({g()} - {g(s="s2")})) AS ds,
     avg(abs({g()} - {g("b2", "n2")})) AS dbn, avg(abs({g()} - {g("b2", s="s2")})) AS dbs, avg(abs({g()} - {g(n="n2", s="s2")})) AS dns FROM q),
   im AS (SELECT 'bal' AS feature_i, 'nat' AS feature_j, dbn - db - dn AS strength FROM a UNION ALL SELECT 'bal', 'seg', dbs - db - ds FROM a UNION ALL SELECT 'nat', 'seg', dns - dn - ds FROM a)"""


def _pairs(spark, sf_dir):
    return E.interaction_matrix(customers(spark, sf_dir), "c_custkey", FEATURES, MIXED)


@query("exp_interaction_matrix", INTER + " SELECT feature_i, feature_j, round(strength, 6) AS strength, CASE WHEN strength > 0 THEN 'synergistic' WHEN strength < 0 THEN 'redundant' ELSE 'none' END AS kind FROM im")
def _interactions(spark, sf_dir):
    return rounded(_pairs(spark, sf_dir).withColumn("kind", E.interaction_type(F.col("strength"))))


@query("exp_interaction_summary", INTER + " SELECT count(*) AS pairs, round(avg(abs(strength)), 6) AS mean_strength, round(max(abs(strength)), 6) AS max_strength, count(*) FILTER (abs(strength) > 0.05) AS strong_pairs, arg_max(feature_i || '*' || feature_j, abs(strength)) AS strongest FROM im")
def _interaction_summary(spark, sf_dir):
    return rounded(E.interaction_summary(_pairs(spark, sf_dir), 0.05))


@query("top_interactions", INTER + " SELECT feature_i, feature_j, round(strength, 6) AS strength FROM im ORDER BY abs(strength) DESC, feature_i, feature_j LIMIT 2")
def _top_interactions(spark, sf_dir):
    from tallywatch.operators.ranking import top_interactions

    return rounded(top_interactions(_pairs(spark, sf_dir), 2))


def _pdp_sql(name: str, slot: str) -> str:
    names = {"b": "bal", "n": "nat", "s": "seg"} | {slot: "gv"}
    return f"""SELECT '{name}' AS feature, point::INTEGER AS point, round(gv, 6) AS grid_value, round(avg({f(names["b"], names["n"], names["s"])}), 6) AS mean_prediction FROM cust,
      (SELECT i AS point, lo + i * (hi - lo) / 19.0::DOUBLE AS gv FROM (SELECT min({name}) AS lo, max({name}) AS hi FROM cust), (SELECT unnest(range(0, 20)) AS i)) GROUP BY point, gv"""


@query("exp_partial_dependence", f"WITH {CUST} {_pdp_sql('bal', 'b')} UNION ALL {_pdp_sql('nat', 'n')}")
def _pdp(spark, sf_dir):
    return rounded(E.partial_dependence(customers(spark, sf_dir), ["bal", "nat", "seg"], LOGIT, 20).where("feature <> 'seg'"))


@query("exp_ale", f"""WITH {CUST}, ed AS (SELECT list_sort(list_distinct(quantile_cont(bal, [0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]))) AS e FROM cust),
   b AS (SELECT cust.*, least(greatest(len(list_filter(e, lambda x: bal > x)), 1), len(e) - 1) AS bin, e FROM cust, ed),
   d AS (SELECT bin, e[bin] AS lo, e[bin + 1] AS hi, count(*) AS n, avg({f("e[bin + 1]")} - {f("e[bin]")}) AS step FROM b GROUP BY ALL),
   r AS (SELECT *, sum(step) OVER (ORDER BY bin) AS s FROM d), c AS (SELECT sum((s - step / 2) * n) / sum(n) AS m FROM r)
   SELECT 'bal' AS feature, bin::INTEGER AS bin, round(lo, 4) AS low, round(hi, 4) AS high, n, round(s - m, 4) AS effect FROM r, c""")
def _ale(spark, sf_dir):
    return rounded(E.accumulated_local_effects(customers(spark, sf_dir), ["bal", "nat", "seg"], LOGIT).where("feature = 'bal'"), 4)


def _ice_sql(name: str, score: str) -> str:
    return f"""SELECT '{name}' AS feature, c_custkey, i AS point, lo + i * (hi - lo) / 49.0::DOUBLE AS gv, {score.replace("GRID", "(lo + i * (hi - lo) / 49.0::DOUBLE)")} AS p
      FROM cust, (SELECT quantile_cont({name}, 0.05) AS lo, quantile_cont({name}, 0.95) AS hi FROM cust), (SELECT unnest(range(0, 50)) AS i)"""


@query("exp_ice", f"""WITH {CUST}, c AS ({_ice_sql("bal", f("GRID"))} UNION ALL {_ice_sql("nat", f(n="GRID"))} UNION ALL {_ice_sql("seg", f(s="GRID"))})
   SELECT feature, c_custkey, point::INTEGER AS point, round(gv, 4) AS grid_value, round(p, 6) AS prediction, round(avg(p) OVER (PARTITION BY feature, point), 6) AS average FROM c""")
def _ice(spark, sf_dir):
    return rounded(E.ice_curves(customers(spark, sf_dir), "c_custkey", FEATURES, LOGIT), 6, grid_value=4)


WHAT_IF = f"""WITH {CUST}, sc AS (SELECT c_custkey, 'richer' AS scenario, bal + 1000 AS b2, NULL::DOUBLE AS n2, NULL::DOUBLE AS s2 FROM cust UNION ALL SELECT c_custkey, 'moved', NULL, 3.0, 9.0 FROM cust),
   w AS (SELECT c_custkey, scenario, {f()} AS original, {f("coalesce(b2, bal)", "coalesce(n2, nat)", "coalesce(s2, seg)")} AS modified FROM cust JOIN sc USING (c_custkey))"""


def _scenarios(spark, sf_dir):
    rows = customers(spark, sf_dir)
    empty = F.lit(None).cast("double")
    richer = rows.select("c_custkey", F.lit("richer").alias("scenario"), (F.col("bal") + 1000).alias("bal"), empty.alias("nat"), empty.alias("seg"))
    moved = rows.select("c_custkey", F.lit("moved").alias("scenario"), empty.alias("bal"), F.lit(3.0).alias("nat"), F.lit(9.0).alias("seg"))
    return E.what_if(rows, richer.unionByName(moved), "c_custkey", FEATURES, LOGIT)


@query("exp_what_if", WHAT_IF + " SELECT c_custkey, scenario, round(original, 6) AS original, round(modified, 6) AS modified, round(modified - original, 6) AS change, round(abs(modified - 0.5) * 2 - abs(original - 0.5) * 2, 6) AS confidence_change FROM w")
def _what_if(spark, sf_dir):
    return rounded(_scenarios(spark, sf_dir))


@query("exp_scenario_compare", WHAT_IF + " SELECT c_custkey, scenario, round(modified - original, 6) AS difference, round((modified - original) / abs(original) * 100, 4) AS relative, CASE WHEN modified > original THEN 'up' WHEN modified < original THEN 'down' ELSE 'same' END AS direction FROM w")
def _compare(spark, sf_dir):
    rows = E.scenario_compare(_scenarios(spark, sf_dir))
    return rounded(rows.select("c_custkey", "scenario", "difference", "relative", "direction"), 6, relative=4)


def _u(seed: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || c_custkey || '|' || cand), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _drawn(name: str) -> str:
    return f"(least({name} * 0.5, {name} * 1.5) + {_u('42|value|' + name)} * (greatest({name} * 0.5, {name} * 1.5) - least({name} * 0.5, {name} * 1.5)))"


def _new(name: str) -> str:
    others = [n for n in FEATURES if n != name]
    ahead = " + ".join(f"({_u('42|pick|' + o)} < {_u('42|pick|' + name)})::INTEGER" for o in others)
    return f"CASE WHEN {ahead} < 2 THEN {_drawn(name)} ELSE {name} END AS new_{name}"


@query("exp_counterfactuals", f"""WITH {CUST}, c AS (SELECT cust.*, {f()} AS original, cand FROM cust, (SELECT unnest(range(1, 31)) AS cand)), d AS (SELECT *, {_new('bal')}, {_new('nat')}, {_new('seg')} FROM c),
   s AS (SELECT *, {f('new_bal', 'new_nat', 'new_seg')} AS prediction, (abs(new_bal - bal) > 1e-6)::INTEGER + (abs(new_nat - nat) > 1e-6)::INTEGER + (abs(new_seg - seg) > 1e-6)::INTEGER AS num_changes FROM d),
   k AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY num_changes, abs(prediction - original), cand) AS rank FROM s WHERE abs(prediction - 0.9) < abs(original - 0.9))
   SELECT c_custkey, rank::INTEGER AS rank, cand::INTEGER AS candidate, round(original, 6) AS original, round(prediction, 6) AS prediction, round(prediction - original, 6) AS prediction_change, num_changes,
   round(new_bal, 4) AS new_bal, round(new_nat, 4) AS new_nat, round(new_seg, 4) AS new_seg FROM k WHERE rank <= 5""")
def _counterfactuals(spark, sf_dir):
    rows = E.counterfactuals(customers(spark, sf_dir), "c_custkey", FEATURES, LOGIT, desired=0.9, max_changes=2, candidates=30)
    return rounded(rows, 6, new_bal=4, new_nat=4, new_seg=4)


def _noise(seed: int) -> str:
    u = lambda letter: f"(('0x' || substr(md5('{seed}{letter}|' || c_custkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
    return f"sqrt(-2 * ln(greatest({u('a')}, 1e-12))) * cos(2 * pi() * {u('b')})"


@query("exp_sensitivity", f"""WITH {CUST}, sd AS (SELECT stddev_pop(bal) * 0.1::DOUBLE AS sb, stddev_pop(nat) * 0.1::DOUBLE AS sn, stddev_pop(seg) * 0.1::DOUBLE AS ss FROM cust),
   a AS (SELECT avg(abs({f(f"bal + {_noise(42)} * sb")} - {f()})) AS bal, avg(abs({f(n=f"nat + {_noise(43)} * sn")} - {f()})) AS nat, avg(abs({f(s=f"seg + {_noise(44)} * ss")} - {f()})) AS seg FROM cust, sd)
   SELECT 'bal' AS feature, round(bal, 6) AS sensitivity FROM a UNION ALL SELECT 'nat', round(nat, 6) FROM a UNION ALL SELECT 'seg', round(seg, 6) FROM a""")
def _sensitivity(spark, sf_dir):
    return rounded(E.sensitivity(customers(spark, sf_dir), "c_custkey", FEATURES, LOGIT, n=None))


@query("exp_sensitivity_sample", f"""WITH {CUST}, sd AS (SELECT stddev_pop(bal) * 0.1::DOUBLE AS sb, stddev_pop(nat) * 0.1::DOUBLE AS sn FROM cust), s AS (SELECT * FROM cust ORDER BY md5('42|' || c_custkey) LIMIT 100),
   a AS (SELECT avg(abs({f(f"bal + {_noise(42)} * sb")} - {f()})) AS bal, avg(abs({f(n=f"nat + {_noise(43)} * sn")} - {f()})) AS nat FROM s, sd)
   SELECT 'bal' AS feature, round(bal, 6) AS sensitivity FROM a UNION ALL SELECT 'nat', round(nat, 6) FROM a""")
def _sensitivity_sample(spark, sf_dir):
    rows = E.sensitivity(customers(spark, sf_dir), "c_custkey", FEATURES, LOGIT, n=100)
    return rounded(rows.where("feature <> 'seg'"))


STEPS = ("kilo", "reg")
STEPPED = """st AS (SELECT floor(c_acctbal / 1000) AS kilo, (c_nationkey % 5)::DOUBLE AS reg, (c_acctbal + 100 * c_nationkey > 5000)::INTEGER AS y FROM customer)"""
# Target: regions 1 and 3, and balances of 8000 or more. The best first split is by region, then by the balance, all other leaves being pure.
STEP_NODES = f"""{STEPPED}, md AS (SELECT max(kilo) FILTER (kilo <= 7) AS a, min(kilo) FILTER (kilo > 7) AS b FROM st WHERE reg NOT IN (1, 3)),
   rt AS (SELECT CASE WHEN reg IN (1, 3) THEN 4 WHEN kilo <= 7 THEN 2 ELSE 3 END AS leaf, y FROM st), up AS (SELECT unnest(CASE WHEN leaf = 4 THEN [0, 4] ELSE [0, 1, leaf] END) AS node_id, y FROM rt),
   ct AS (SELECT node_id, y, count(*) AS k FROM up GROUP BY ALL),
   ns AS (SELECT node_id, sum(k)::BIGINT AS samples, 1 - sum(k::DOUBLE * k) / sum(k) ** 2 AS impurity, max(k) / sum(k)::DOUBLE AS purity, arg_max(y, (k, y)) AS majority FROM ct GROUP BY node_id),
   sh AS (SELECT * FROM (VALUES (0, NULL, 0, 'reg', NULL, NULL, [0.0, 2.0, 4.0]), (1, 0, 1, 'kilo', 'left', NULL, NULL), (2, 1, 2, NULL, 'left', 0.0, NULL), (3, 1, 2, NULL, 'right', 1.0, NULL), (4, 0, 1, NULL, 'right', 1.0, NULL))
     t(node_id, parent_id, depth, feature, side, prediction, categories))"""


def stepped(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(
        F.floor(F.col("c_acctbal") / 1000).cast("double").alias("kilo"), (F.col("c_nationkey") % 5).cast("double").alias("reg"),
        (F.col("c_acctbal") + 100 * F.col("c_nationkey") > 5000).cast("int").alias("y"),
    )


def _step_tree(rows):
    rule = scoring.ColumnScorer(lambda x: F.when(x["reg"].isin(1.0, 3.0) | (x["kilo"] > 7), 1.0).otherwise(0.0))
    model, fidelity = E.surrogate_tree(rows, STEPS, rule, max_depth=3, categories={"reg": 5})
    return E.tree_nodes(model, STEPS), fidelity


@query("exp_surrogate_tree", f"WITH {STEPPED} SELECT 1.0::DOUBLE AS fidelity, count(*) AS n FROM st WHERE kilo IS NOT NULL AND reg IS NOT NULL")
def _surrogate(spark, sf_dir):
    return rounded(_step_tree(stepped(spark, sf_dir))[1], 4)


@query("exp_tree_nodes", f"""WITH {STEP_NODES} SELECT node_id, parent_id, depth, feature, CASE feature WHEN 'kilo' THEN round((a + b) / 2, 4) END AS threshold, side, prediction::DOUBLE AS prediction, categories::DOUBLE[] AS categories,
   samples, round(impurity, 4) AS impurity, round(purity, 4) AS purity, majority FROM sh JOIN ns USING (node_id), md""")
def _nodes(spark, sf_dir):
    rows = stepped(spark, sf_dir)
    nodes, _ = _step_tree(rows)
    return rounded(E.node_table(spark, nodes).join(E.node_stats(rows, nodes, "y"), "node_id"), 4)


@query("exp_tree_stats", f"""WITH {STEP_NODES} SELECT count(*) AS nodes, count(*) FILTER (feature IS NULL) AS leaves, max(depth) AS max_depth, round(avg(depth) FILTER (feature IS NULL), 4) AS mean_leaf_depth,
   round(avg(purity) FILTER (feature IS NULL), 4) AS mean_leaf_purity FROM sh JOIN ns USING (node_id)""")
def _tree_stats(spark, sf_dir):
    rows = stepped(spark, sf_dir)
    nodes, _ = _step_tree(rows)
    return rounded(E.tree_stats(nodes, materialise(E.node_stats(rows, nodes, "y"))), 4)


def _node(node_id, parent, depth, feature, threshold, side):
    return {"node_id": node_id, "parent_id": parent, "depth": depth, "feature": feature, "threshold": threshold, "side": side, "prediction": None}


# A tree written down by hand, so that SQL can follow it.
TREE = [
    _node(0, None, 0, "bal", 3500.0, None),
    _node(1, 0, 1, "nat", 18.0, "left"),
    _node(2, 1, 2, None, None, "left"),
    _node(3, 1, 2, None, None, "right"),
    _node(4, 0, 1, "bal", 5000.0, "right"),
    _node(5, 4, 2, None, None, "left"),
    _node(6, 4, 2, None, None, "right"),
]


LEAF = """CASE WHEN bal <= 3500 THEN CASE WHEN nat <= 18 THEN 2 ELSE 3 END ELSE CASE WHEN bal <= 5000 THEN 5 ELSE 6 END END"""


@query("exp_node_stats", f"""WITH {CUST}, l AS (SELECT {LEAF} AS leaf, y FROM cust), n AS (SELECT unnest([0, CASE WHEN leaf < 4 THEN 1 ELSE 4 END, leaf]) AS node_id, y FROM l),
   c AS (SELECT node_id, y, count(*) AS k FROM n GROUP BY ALL) SELECT node_id, sum(k)::BIGINT AS samples, round(1 - sum(k::DOUBLE * k) / sum(k) ** 2, 6) AS impurity, round(max(k) / sum(k)::DOUBLE, 6) AS purity, arg_max(y, (k, y)) AS majority FROM c GROUP BY node_id""")
def _node_stats(spark, sf_dir):
    return rounded(E.node_stats(customers(spark, sf_dir), TREE, "y"))


@query("exp_decision_rules", f"""WITH {CUST}, c AS (SELECT {LEAF} AS leaf, y, count(*) AS k FROM cust GROUP BY ALL), s AS (SELECT leaf, sum(k)::BIGINT AS support, 1 - sum(k::DOUBLE * k) / sum(k) ** 2 AS imp, arg_max(y, (k, y)) AS prediction FROM c GROUP BY leaf)
   SELECT leaf, CASE leaf WHEN 2 THEN 'bal <= 3500.000 AND nat <= 18.000' WHEN 3 THEN 'bal <= 3500.000 AND nat > 18.000' WHEN 5 THEN 'bal > 3500.000 AND bal <= 5000.000' ELSE 'bal > 3500.000 AND bal > 5000.000' END AS rule,
   prediction, support, round(CASE WHEN imp < 0.5 THEN 1 - imp ELSE imp END, 6) AS confidence FROM s WHERE support >= 10 AND CASE WHEN imp < 0.5 THEN 1 - imp ELSE imp END >= 0.8""")
def _rules(spark, sf_dir):
    return rounded(E.decision_rules(customers(spark, sf_dir), TREE, "y"))


def _walk(bal: bool, nat: bool) -> str:
    """What the tree predicts of a row when only some features are known; the others are averaged by the rows of each side."""
    low = "CASE WHEN nat <= 18 THEN v2 ELSE v3 END" if nat else "(n2 * v2 + n3 * v3) / (n2 + n3)"
    high = "CASE WHEN bal <= 5000 THEN v5 ELSE v6 END" if bal else "(n5 * v5 + n6 * v6) / (n5 + n6)"
    if bal:
        return f"CASE WHEN bal <= 3500 THEN {low} ELSE {high} END"
    return f"((n2 + n3) * ({low}) + (n5 + n6) * ({high})) / (n2 + n3 + n5 + n6)"


@query("exp_shap_tree", f"""WITH {CUST}, l AS (SELECT {LEAF} AS leaf, y FROM cust),
   k AS (SELECT {", ".join(f"count(*) FILTER (leaf = {i})::DOUBLE AS n{i}, coalesce(avg(y) FILTER (leaf = {i}), 0)::DOUBLE AS v{i}" for i in (2, 3, 5, 6))} FROM l),
   w AS (SELECT c_custkey, {_walk(False, False)} AS e, {_walk(True, False)} AS b, {_walk(False, True)} AS n, {_walk(True, True)} AS bn FROM cust, k)
   SELECT c_custkey, unnest(['bal', 'nat', 'seg']) AS feature, round(unnest([(b - e + bn - n) / 2, (n - e + bn - b) / 2, 0.0]), 6) AS attribution, round(e, 6) AS base, round(bn, 6) AS prediction FROM w""")
def _shap_tree(spark, sf_dir):
    rows = customers(spark, sf_dir)
    return rounded(T.tree_shap(rows, "c_custkey", FEATURES, [(1.0, T.with_covers(rows, TREE, "y"))]))
