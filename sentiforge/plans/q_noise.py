"""Label-noise family: thresholds, confident joint, latent estimates,
pruning, ranked error report, noise injection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sentiforge.operators import noise as N
from sentiforge.operators.sampling import inject_noise, noise_matrix_from_trace
from sentiforge.plans import sqltext as S
from sentiforge.plans.registry import register
from sentiforge.plans.standins import CLASSES, corpus, labelled, scores, with_sql

K = 3
FRAC_NOISE = 0.37
TOP_ERRORS = 100
NOISE_DIAG, NOISE_ZERO, NOISE_SEED = 0.67, 0.5, 0


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


# -- oracle helpers ----------------------------------------------------------
def _arr(items):
    return "[" + ", ".join(items) + "]"


_THR = ", ".join(f"avg(CASE WHEN label = {j} THEN p[{j + 1}] END) AS t{j}" for j in range(K))
_MASK = _arr([f"CASE WHEN p[{j + 1}] >= t{j} THEN p[{j + 1}] ELSE -1.0 END" for j in range(K)])
_CNT = ", ".join(["count(*) AS n"] + [f"count(*) FILTER (WHERE label = {i}) AS n{i}" for i in range(K)]
                 + [f"count(*) FILTER (WHERE label = {i} AND true_label = {j}) AS c{i}_{j}"
                    for i in range(K) for j in range(K)])


def _rs(i):
    return " + ".join(f"c{i}_{j}" for j in range(K))


_SCALED = ", ".join(f"CASE WHEN {_rs(i)} > 0 THEN c{i}_{j} / ({_rs(i)}) * n{i} ELSE 0.0 END AS s{i}_{j}"
                    for i in range(K) for j in range(K))
_TOT = " + ".join(f"s{i}_{j}" for i in range(K) for j in range(K))
_CAL = ", ".join(f"CASE WHEN {_TOT} > 0 THEN s{i}_{j} / ({_TOT}) * n ELSE 0.0 END AS cal{i}_{j}"
                 for i in range(K) for j in range(K))

JOINT_SQL = f""",
thr AS (SELECT {_THR} FROM scores),
cm AS (SELECT uid, label, p, {_MASK} AS m FROM scores, thr),
cc AS (SELECT uid, label, p, CASE WHEN list_max(m) >= 0 THEN CAST(list_position(m, list_max(m)) - 1 AS INTEGER) END AS true_label FROM cm),
cnt AS (SELECT {_CNT} FROM cc),
sc AS (SELECT *, {_SCALED} FROM cnt),
wide AS (SELECT *, {_CAL} FROM sc)"""

_PRED = "CAST(list_position(p, list_max(p)) - 1 AS INTEGER)"
_MARGIN = "p[label + 1] - list_max(list_filter(p, lambda x, i: i - 1 <> label))"


def _cells_sql():
    return "\n  UNION ALL ".join(
        f"SELECT {i} AS label, {j} AS j, CAST(floor({FRAC_NOISE} * cal{i}_{j} + 0.5) AS BIGINT) AS n_cut FROM wide"
        for i in range(K) for j in range(K) if i != j)


def _class_cut_sql():
    return "\n  UNION ALL ".join(
        f"SELECT {i} AS label, CAST(floor({FRAC_NOISE} * ({' + '.join(f'cal{i}_{j}' for j in range(K) if j != i)}) + 0.5) AS BIGINT) AS n_cut FROM wide"
        for i in range(K))


PICK_SQL = JOINT_SQL + f""",
cells AS ({_cells_sql()}),
pairs AS (SELECT uid, label, j, p[j + 1] - p[label + 1] AS margin
          FROM scores, (SELECT CAST(unnest(range({K})) AS INTEGER) AS j) WHERE j <> label),
picked_nr AS (SELECT DISTINCT uid FROM (
    SELECT uid, n_cut, row_number() OVER (PARTITION BY label, j ORDER BY margin DESC, uid) AS rn
    FROM pairs JOIN cells USING (label, j)) WHERE rn <= n_cut),
class_cut AS ({_class_cut_sql()}),
picked_cl AS (SELECT uid FROM (
    SELECT uid, n_cut, row_number() OVER (PARTITION BY label ORDER BY p[label + 1], uid) AS rn
    FROM scores JOIN class_cut USING (label)) WHERE rn <= n_cut),
judged AS (SELECT uid, label, {_PRED} AS pred, {_MARGIN} AS margin FROM scores)"""


def _errors_sql(picked: str) -> str:
    return with_sql("scores", PICK_SQL + f"""
SELECT uid, label, pred, round(margin, 6) AS margin FROM judged
WHERE pred <> label AND uid IN ({picked})""")


# -- queries -----------------------------------------------------------------
@register("class_thresholds", with_sql("scores", f""",
t AS (SELECT {', '.join(f"avg(CASE WHEN label = {j} THEN p[{j + 1}] END) AS t{j}, count(*) FILTER (WHERE label = {j}) AS n{j}" for j in range(K))} FROM scores)
""" + "\nUNION ALL ".join(f"SELECT {j} AS cls, round(t{j}, 6) AS threshold, n{j} AS n_rows FROM t" for j in range(K))))
def class_thresholds(spark, sf):
    t = N.threshold_table(scores(spark, sf), K)
    return t.select("cls", _r6("threshold"), "n_rows")


@register("confident_joint", with_sql("scores", JOINT_SQL + "\n" + "\nUNION ALL ".join(
    f"SELECT {i} AS given_label, {j} AS true_label, c{i}_{j} AS count, round(cal{i}_{j}, 6) AS calibrated FROM wide"
    for i in range(K) for j in range(K))))
def confident_joint(spark, sf):
    return N.confident_joint(scores(spark, sf), K).select("given_label", "true_label", "count", _r6("calibrated"))


def _latent_sql():
    cs = {j: " + ".join(f"cal{i}_{j}" for i in range(K)) for j in range(K)}
    rs = {i: " + ".join(f"cal{i}_{j}" for j in range(K)) for i in range(K)}

    def div(a, b):
        return f"(CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0 END)"

    inv = {(i, j): div(f"cal{i}_{j}", rs[i]) for i in range(K) for j in range(K)}
    py = {j: " + ".join(f"{inv[(i, j)]} * (n{i} / n)" for i in range(K)) for j in range(K)}
    return "\nUNION ALL ".join(
        f"SELECT {i} AS given_label, {j} AS true_label, round({div(f'cal{i}_{j}', cs[j])}, 6) AS noise_rate, "
        f"round({inv[(i, j)]}, 6) AS inv_noise_rate, round({py[j]}, 6) AS py_true FROM wide"
        for i in range(K) for j in range(K))


@register("latent_noise", with_sql("scores", JOINT_SQL + "\n" + _latent_sql()))
def latent_noise(spark, sf):
    return N.latent_noise(scores(spark, sf), K).select(
        "given_label", "true_label", _r6("noise_rate"), _r6("inv_noise_rate"), _r6("py_true"))


_M = noise_matrix_from_trace(K, NOISE_DIAG, NOISE_ZERO)


def _inverse_sql():
    joint = {(s, y): f"({_M[s][y]!r}::DOUBLE * py{y})" for s in range(K) for y in range(K)}
    ps = {s: " + ".join(joint[(s, y)] for y in range(K)) for s in range(K)}
    pri = ", ".join(f"count(*) FILTER (WHERE label = {y}) / count(*) AS py{y}" for y in range(K))
    return with_sql("labelled", f""",
pri AS (SELECT {pri} FROM labelled)
""" + "\nUNION ALL ".join(
        f"SELECT {s} AS given_label, {y} AS true_label, "
        f"round(CASE WHEN {ps[s]} > 0 THEN {joint[(s, y)]} / ({ps[s]}) ELSE 0.0 END, 6) AS inv_noise_rate FROM pri"
        for s in range(K) for y in range(K)))


@register("inverse_noise", _inverse_sql())
def inverse_noise(spark, sf):
    """Inverse noise matrix from the label prior of the corpus and a fixed-trace noise matrix."""
    lab = labelled(spark, sf)
    prior = lab.groupBy(F.col("label").alias("cls")).agg(F.count(F.lit(1)).alias("_n"))
    prior = prior.withColumn("py", F.col("_n") / lab.select(F.count(F.lit(1))).scalar())
    return N.inverse_from_prior(prior, _M).select("given_label", "true_label", _r6("inv_noise_rate"))


def _errors(spark, sf, method):
    e = N.label_errors(scores(spark, sf), K, method, FRAC_NOISE)
    return e.select("uid", "label", "pred", _r6("margin"))


@register("prune_noise_rate", _errors_sql("SELECT uid FROM picked_nr"))
def prune_noise_rate(spark, sf):
    return _errors(spark, sf, "prune_by_noise_rate")


@register("prune_class", _errors_sql("SELECT uid FROM picked_cl"))
def prune_class(spark, sf):
    return _errors(spark, sf, "prune_by_class")


@register("prune_both", _errors_sql("SELECT uid FROM picked_nr INTERSECT SELECT uid FROM picked_cl"))
def prune_both(spark, sf):
    return _errors(spark, sf, "both")


_RANKED_SQL = with_sql("scores", PICK_SQL + f""",
errs AS (SELECT uid, label, pred, margin FROM judged WHERE pred <> label AND uid IN (SELECT uid FROM picked_nr))
SELECT CAST(row_number() OVER (ORDER BY margin, uid) AS INTEGER) AS rank, uid, label, pred, round(margin, 6) AS margin
FROM errs ORDER BY margin, uid LIMIT {TOP_ERRORS}""")


def _ranked(spark, sf):
    e = N.label_errors(scores(spark, sf), K, "prune_by_noise_rate", FRAC_NOISE)
    top = e.orderBy("margin", "uid").limit(TOP_ERRORS)  # partial top-k per task, then one merge of k rows
    return top.withColumn("rank", F.row_number().over(Window.orderBy("margin", "uid")))  # window over k rows


@register("label_errors_ranked", _RANKED_SQL)
def label_errors_ranked(spark, sf):
    """The 100 most likely label errors, most negative normalised margin first."""
    return _ranked(spark, sf).select("rank", "uid", "label", "pred", _r6("margin"))


_CLASS_SQL = "[" + ", ".join(S.lit(c) for c in CLASSES) + "]"


@register("label_error_report", with_sql("scores", PICK_SQL + f""",
errs AS (SELECT uid, label, pred, margin FROM judged WHERE pred <> label AND uid IN (SELECT uid FROM picked_nr)),
top AS (SELECT *, row_number() OVER (ORDER BY margin, uid) AS rank FROM errs ORDER BY margin, uid LIMIT {TOP_ERRORS}),
docs AS (SELECT doc_id AS uid, text FROM documents)
SELECT CAST(rank AS INTEGER) AS rank,
       'Estimated Error in ' || CAST(uid AS VARCHAR) || chr(10) || 'predicted ' || {_CLASS_SQL}[pred + 1] || chr(10)
       || ' sentence ' || text || chr(10) || ' -----' AS record
FROM top JOIN docs USING (uid)"""))
def label_error_report(spark, sf):
    """The four-line text record per ranked error (index, predicted class, sentence, rule)."""
    top = _ranked(spark, sf)
    docs = corpus(spark, sf).select("uid", "text")
    names = F.array(*[F.lit(c) for c in CLASSES])
    rec = F.format_string("Estimated Error in %d\npredicted %s\n sentence %s\n -----",
                          F.col("uid"), F.get(names, F.col("pred")), F.col("text"))
    return top.join(docs, "uid").select(F.col("rank").cast("int").alias("rank"), rec.alias("record"))


_CUM = "[" + ", ".join(
    "[" + ", ".join(repr(sum(_M[s][y] for s in range(t + 1)) if t < K - 1 else 1.0 + 1e-12) + "::DOUBLE"
                    for t in range(K)) + "]" for y in range(K)) + "]"
_INJECT_SQL = with_sql("labelled", f""",
noisy AS (SELECT uid, label, CAST(list_position(list_transform({_CUM}[label + 1], lambda c: {S.uniform(str(NOISE_SEED), "'noise'", 'uid')} < c), true) - 1 AS INTEGER) AS noisy_label
          FROM labelled)""")


@register("inject_label_noise", _INJECT_SQL + "\nSELECT uid, label, noisy_label FROM noisy")
def inject_label_noise(spark, sf):
    lab = labelled(spark, sf).select("uid", "label")
    return inject_noise(lab, "uid", "label", _M, NOISE_SEED)


@register("flipped_count", _INJECT_SQL + """
SELECT count(*) FILTER (WHERE noisy_label <> label) AS n_flipped, count(*) AS n FROM noisy""")
def flipped_count(spark, sf):
    n = inject_label_noise(spark, sf)
    return n.agg(F.count_if(F.col("noisy_label") != F.col("label")).alias("n_flipped"), F.count(F.lit(1)).alias("n"))


# -- latent estimates made consistent, and joints from given matrices ----------
def _converged_sql():
    nm = {(s, y): f"nm{s}_{y}" for s in range(K) for y in range(K)}

    def div(a, b):
        return f"(CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0::DOUBLE END)"

    def inv(s, y, t=""):
        return div(f"{t}nm{s}_{y} * {t}py{y}", " + ".join(f"{t}nm{s}_{z} * {t}py{z}" for z in range(K)))

    start = ", ".join(
        [f"n{s} / n AS ps{s}" for s in range(K)]
        + [f"{div(f'c{s}_{y}', ' + '.join(f'c{t}_{y}' for t in range(K)))} AS nm{s}_{y}" for s, y in nm]
        + [f"{' + '.join(div(f'c{s}_{y}', ' + '.join(f'c{s}_{z}' for z in range(K))) + f' * (n{s} / n)' for s in range(K))} AS py{y}"
           for y in range(K)])
    keep = ", ".join([f"ps{s}" for s in range(K)] + list(nm.values()))
    new = ", ".join(f"{' + '.join(f'{inv(s, y, "it.")} * it.ps{s}' for s in range(K))} AS py{y}" for y in range(K))
    moved = ", ".join(f"abs(new.py{y} - it.py{y})" for y in range(K))
    last = ", ".join(f"{inv(s, y)} AS inv{s}_{y}" for s, y in nm)
    pri = ", ".join(f"{' + '.join(f'inv{s}_{y} * ps{s}' for s in range(K))} AS py{y}" for y in range(K))
    return with_sql("scores", JOINT_SQL + f""",
start AS (SELECT {start} FROM wide),
it AS (SELECT 0 AS i, 1.0::DOUBLE AS delta, {keep}, {', '.join(f'py{y}' for y in range(K))} FROM start
       UNION ALL
       SELECT it.i + 1, greatest({moved}), {', '.join('it.' + c for c in keep.split(', '))}, {', '.join(f'new.py{y}' for y in range(K))}
       FROM it, LATERAL (SELECT {new}) new WHERE it.delta >= 1e-12 AND it.i < 1000),
final AS (SELECT * FROM it ORDER BY i DESC LIMIT 1),
fin AS (SELECT * EXCLUDE ({', '.join(f'py{y}' for y in range(K))}), {last} FROM final),
res AS (SELECT *, {pri} FROM fin)
""" + "\nUNION ALL ".join(
        f"SELECT {s} AS given_label, {y} AS true_label, round({div(f'inv{s}_{y} * ps{s}', f'py{y}')}, 6) AS noise_rate, "
        f"round(inv{s}_{y}, 6) AS inv_noise_rate, round(py{y}, 6) AS py_true FROM res" for s, y in nm)
    ).replace("WITH ", "WITH RECURSIVE ", 1)


@register("latent_converged", _converged_sql())
def latent_converged(spark, sf):
    """Prior, noise matrix and inverse matrix of the raw joint, iterated until they agree."""
    return N.latent_from_counts(scores(spark, sf), K, converge=True).select(
        "given_label", "true_label", _r6("noise_rate"), _r6("inv_noise_rate"), _r6("py_true"))


#: the inverse matrix that goes with the given noise matrix where all classes are equally likely
_INV = [[_M[s][y] / sum(_M[s]) for y in range(K)] for s in range(K)]


def _given_sql():
    import numpy as np
    solve = np.linalg.inv(np.asarray(_M))
    lit = lambda x: f"{float(x)!r}::DOUBLE"
    raw = ", ".join(f"greatest({' + '.join(f'{lit(solve[y][s])} * (n{s} / n)' for s in range(K))}, 0.0) AS r{y}" for y in range(K))
    part = {s: " + ".join(f"{lit(_M[s][y])} * r{y}" for y in range(K)) for s in range(K)}
    by_noise = ", ".join(f"CASE WHEN ({part[s]}) > 0 THEN ({lit(_M[s][y])} * r{y}) / ({part[s]}) ELSE 0.0 END * n{s} AS cal{s}_{y}"
                         for s in range(K) for y in range(K))
    by_inverse = ", ".join(f"{lit(_INV[s][y])} * n{s} AS cal{s}_{y}" for s in range(K) for y in range(K))
    cals = ", ".join(f"cal{s}_{y}" for s in range(K) for y in range(K))
    cells = "\n  UNION ALL ".join(
        f"SELECT form, {i} AS label, {j} AS j, CAST(floor({FRAC_NOISE} * cal{i}_{j} + 0.5) AS BIGINT) AS n_cut FROM forms"
        for i in range(K) for j in range(K) if i != j)
    return with_sql("scores", JOINT_SQL + f""",
given AS (SELECT *, {raw} FROM cnt),
forms AS (SELECT 'estimated' AS form, {cals} FROM wide
  UNION ALL SELECT 'noise' AS form, {by_noise} FROM given
  UNION ALL SELECT 'noise and inverse' AS form, {by_inverse} FROM given),
cells AS ({cells}),
pairs AS (SELECT uid, label, j, p[j + 1] - p[label + 1] AS margin
          FROM scores, (SELECT CAST(unnest(range({K})) AS INTEGER) AS j) WHERE j <> label),
picked AS (SELECT DISTINCT form, uid FROM (
    SELECT form, uid, n_cut, row_number() OVER (PARTITION BY form, label, j ORDER BY margin DESC, uid) AS rn
    FROM pairs JOIN cells USING (label, j)) WHERE rn <= n_cut),
errs AS (SELECT form, uid FROM picked JOIN scores USING (uid) WHERE {_PRED} <> label)
SELECT form, uid, label FROM scores, (SELECT form FROM forms) f
WHERE NOT EXISTS (SELECT 1 FROM errs e WHERE e.form = f.form AND e.uid = scores.uid)""")


@register("kept_by_joint", _given_sql())
def kept_by_joint(spark, sf):
    """The rows that learning with noisy labels keeps, with the joint estimated, from a given noise
    matrix, and from a given noise matrix and its inverse."""
    from sentiforge.scratch import written
    s = written(scores(spark, sf), "scores")
    joints = {"estimated": None, "noise": N.joint_from_matrices(s, K, _M),
              "noise and inverse": N.joint_from_matrices(s, K, _M, _INV)}
    out = None
    for form, joint in joints.items():
        errors = N.label_errors(s, K, "prune_by_noise_rate", FRAC_NOISE, joint).select("uid")
        kept = s.join(errors, "uid", "left_anti").select(F.lit(form).alias("form"), "uid", "label")
        out = kept if out is None else out.unionByName(kept)
    return out
