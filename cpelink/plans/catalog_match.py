"""Registered queries for fuzzy scoring, candidate joins and classification.

Score twins run the SQL LCS of :mod:`sql_scores`; the vendor candidate twin
is a brute-force cross product with the scorer used as the gate, which checks
that the blocked Spark joins lose no pair.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import normalize as N
from ..functions import scoring as S
from ..operators import candidates as CA
from ..operators import classify as CL
from ..operators import evaluate as EV
from . import inputs as I
from . import sql_scores as Q
from .catalog import _JR, _JU, _PUB_TOKS, _VEN_TOKS, _clean_sql
from ..session import materialize, scratch_path
from .registry import register

_SCORE_COLS = {
    "score_ratio": "ratio", "score_partial_ratio": "partial", "score_token_set": "token_set",
    "score_partial_token_set": "ptl_token_set", "score_token_sort": "token_sort",
    "score_partial_token_sort": "ptl_token_sort", "score_weighted": "weighted",
}


def _staged(src: str, a: str, b: str, prefix: str) -> str:
    """CTE continuation: ``src`` -> processed -> sorted / set strings, named {prefix}s2."""
    first, second = Q.stage_columns(a, b, prefix)
    return (f", {prefix}s1 AS (SELECT *, {first} FROM {src}), "
            f"{prefix}s2 AS (SELECT *, {second} FROM {prefix}s1)\n")


# labelled software pairs: vendor stripped from title and display name
_LP = (", lp AS (SELECT vendor_X, software_X, title_X, DisplayName0, release_X, Version0, match, t_cve_name, "
       "replace(lower(title_X), vendor_X, ' ') AS ta, replace(lower(DisplayName0), vendor_X, ' ') AS tb "
       "FROM f_software_labels)\n") + _staged("lp", "ta", "tb", "_")
_LP_SC = Q.scores("ta", "tb", "_")


def _label_pairs(s, d):
    lab = I.software_labels(s, d)
    return lab.select("*", N.strip_vendor("title_X", "vendor_X").alias("ta"),
                      N.strip_vendor("DisplayName0", "vendor_X").alias("tb"))


def _make_score_query(field: str):
    def q(s, d):
        p = _label_pairs(s, d)
        return p.select(*K.SOFTWARE_KEYS, S.pair_scores(F.col("ta"), F.col("tb"), [field])[field].alias("score"))
    return q


for _key, _field in _SCORE_COLS.items():
    register(_key, _LP + f"SELECT {', '.join(K.SOFTWARE_KEYS)}, {_LP_SC[_field]} AS score FROM _s2")(
        _make_score_query(_field))


# --- features of labelled pairs (the model inputs, in training order) -----------

_REL = f"{Q.ratio('release_X', 'Version0')} AS fz_rel_ratio, {Q.partial_ratio('release_X', 'Version0')} AS fz_rel_ptl_ratio"
_FEAT_SW_SQL = _LP + f"""SELECT {', '.join(K.SOFTWARE_KEYS)}, match, t_cve_name,
 {_LP_SC['ratio']} AS fz_ratio, {_LP_SC['partial']} AS fz_ptl_ratio, {_LP_SC['ptl_token_set']} AS fz_tok_set_ratio,
 {_LP_SC['token_sort']} AS fz_ptl_tok_sort_ratio, {_LP_SC['weighted']} AS fz_uwratio, {_REL},
 CAST(length(title_X) AS INTEGER) AS titlX_len, CAST(length(DisplayName0) AS INTEGER) AS DsplyNm0_len FROM _s2"""


def label_features_software(s, d):
    """Labelled software pairs with the nine model features."""
    p = _label_pairs(s, d).select(
        "*", S.pair_scores(F.col("ta"), F.col("tb"), ["ratio", "partial", "ptl_token_set", "token_sort", "weighted"]).alias("s"),
        S.pair_ratio(F.col("release_X"), F.col("Version0")).alias("r"))
    return p.select(
        *K.SOFTWARE_KEYS, "match", "t_cve_name",
        F.col("s.ratio").alias("fz_ratio"), F.col("s.partial").alias("fz_ptl_ratio"),
        F.col("s.ptl_token_set").alias("fz_tok_set_ratio"), F.col("s.token_sort").alias("fz_ptl_tok_sort_ratio"),
        F.col("s.weighted").alias("fz_uwratio"), F.col("r.ratio").alias("fz_rel_ratio"),
        F.col("r.partial").alias("fz_rel_ptl_ratio"),
        F.char_length("title_X").alias("titlX_len"), F.char_length("DisplayName0").alias("DsplyNm0_len"))


register("features_software", _FEAT_SW_SQL)(label_features_software)


@register("best_match", ", feat AS (" + _FEAT_SW_SQL.lstrip(", ").replace("lp AS", "WITH lp AS", 1) + """)
SELECT vendor_X, DisplayName0, Version0, t_cve_name FROM (
 SELECT *, row_number() OVER (PARTITION BY vendor_X, DisplayName0, Version0
  ORDER BY fz_uwratio DESC, software_X, title_X, release_X, t_cve_name) AS rn FROM feat WHERE match = 1) b WHERE rn = 1""")
def _best_match(s, d):
    return CL.match_project_software(CL.best_match(CL.positive_only(label_features_software(s, d))))


# --- vendor stage: candidates vs brute force -----------------------------------------

_VEN_BRUTE = (
    f""", bp AS (SELECT DISTINCT lower(replace(Publisher0, ' ', '_')) AS publisher0 FROM inv WHERE Publisher0 IS NOT NULL),
 bp2 AS (SELECT publisher0, {_clean_sql(_PUB_TOKS)} AS pub0_cln FROM bp),
 bv AS (SELECT DISTINCT lower(replace(vendor_X, ' ', '_')) AS vendor_X FROM cpe WHERE vendor_X IS NOT NULL),
 bv2 AS (SELECT vendor_X, {_clean_sql(_VEN_TOKS)} AS ven_cln FROM bv),
 vx AS (SELECT * FROM bp2 CROSS JOIN bv2 WHERE length(ven_cln) >= 2 AND length(ven_cln) <= length(pub0_cln))\n"""
    + _staged("vx", "ven_cln", "pub0_cln", "v_"))
_VSC = Q.scores("ven_cln", "pub0_cln", "v_")
_VEN_CANDS = (_VEN_BRUTE + f""", vc AS (SELECT publisher0, pub0_cln, vendor_X, ven_cln, {_VSC['ratio']} AS fz_ratio,
 {_VSC['partial']} AS fz_ptl_ratio, {_VSC['token_set']} AS fz_tok_set_ratio,
 {_VSC['ptl_token_sort']} AS fz_ptl_tok_sort_ratio, {_VSC['weighted']} AS fz_uwratio
 FROM v_s2 WHERE {_VSC['ptl_token_set']} = 100)\n""")


def vendor_candidates(s, d):
    return CA.vendor_candidates(I.inventory(s, d), I.catalogue(s, d))


register("vendor_candidates", _VEN_CANDS + "SELECT * FROM vc")(vendor_candidates)

register("vendor_gate_pairs", _VEN_CANDS + "SELECT publisher0, vendor_X FROM vc")(
    lambda s, d: vendor_candidates(s, d).select("publisher0", "vendor_X"))

_VLAB = ", vl AS (SELECT publisher0, vendor_X, max(match) AS match FROM f_vendor_labels GROUP BY publisher0, vendor_X)\n"


def _vendor_looked(s, d):
    # scored candidates feed training and classification: write them once
    c = materialize(CA.name_lengths_vendor(vendor_candidates(s, d)), "vendor_candidates")
    return CL.label_lookup(c, I.vendor_labels(s, d), K.VENDOR_KEYS)


register("label_lookup", _VEN_CANDS + _VLAB + """SELECT vc.*, CAST(length(vc.vendor_X) AS INTEGER) AS ven_len,
 CAST(length(vc.publisher0) AS INTEGER) AS pu0_len, vl.match FROM vc LEFT JOIN vl
 ON vc.publisher0 = vl.publisher0 AND vc.vendor_X = vl.vendor_X""")(_vendor_looked)

register("split_labelled", _VEN_CANDS + _VLAB + """SELECT vc.publisher0, vc.vendor_X, vl.match FROM vc JOIN vl
 ON vc.publisher0 = vl.publisher0 AND vc.vendor_X = vl.vendor_X""")(
    lambda s, d: CL.split_labelled(_vendor_looked(s, d))[1].select("publisher0", "vendor_X", "match"))

register("split_unlabelled", _VEN_CANDS + _VLAB + """SELECT vc.publisher0, vc.vendor_X FROM vc LEFT JOIN vl
 ON vc.publisher0 = vl.publisher0 AND vc.vendor_X = vl.vendor_X WHERE vl.match IS NULL""")(
    lambda s, d: CL.split_labelled(_vendor_looked(s, d))[0].select("publisher0", "vendor_X"))

register("features_vendor", _VEN_CANDS + """SELECT publisher0, vendor_X, fz_ptl_ratio, fz_ptl_tok_sort_ratio, fz_ratio,
 fz_tok_set_ratio, fz_uwratio, CAST(length(vendor_X) AS INTEGER) AS ven_len,
 CAST(length(publisher0) AS INTEGER) AS pu0_len FROM vc""")(
    lambda s, d: CA.name_lengths_vendor(vendor_candidates(s, d)).select(*K.VENDOR_KEYS, *K.VENDOR_FEATURES))


# --- software stage --------------------------------------------------------------------

def _java_sql(cpe23: str, vendor: str, software: str, release: str) -> str:
    """SQL twin of the JDK/JRE release rule (expression form)."""
    ju, jr = _JU, _JR
    hu = f"contains({cpe23}, 'update')"
    sft = f"(CASE WHEN {hu} THEN regexp_extract({cpe23}, '{ju}', 2) ELSE regexp_extract({cpe23}, '{jr}', 2) END)"
    rel = f"(CASE WHEN {hu} THEN regexp_extract({cpe23}, '{ju}', 3) ELSE regexp_extract({cpe23}, '{jr}', 3) END)"
    tmp = (f"(CASE WHEN {hu} THEN regexp_extract({cpe23}, '{ju}', 3) || '.' || regexp_extract({cpe23}, '{ju}', 4) || '0' "
           f"ELSE regexp_extract({cpe23}, '{jr}', 3) END)")
    ok = f"(CASE WHEN {hu} THEN regexp_matches({cpe23}, '{ju}') ELSE regexp_matches({cpe23}, '{jr}') END)"
    return (f"(CASE WHEN {vendor} IN ('oracle', 'sun') AND {software} IN ('jre', 'jdk') THEN "
            f"CASE WHEN NOT {ok} THEN '-' WHEN contains({rel}, '_') THEN '1.' || {rel} WHEN {sft} = 'jre' THEN {tmp} "
            f"WHEN starts_with({rel}, '8.') THEN {tmp} ELSE '1.' || {tmp} END ELSE {release} END)")


_NO_VERSION = "(rel_tmp = '-' OR Version0 = '-')"
_VG_BRUTE = (
    f""", cj AS (SELECT p.vendor_X, p.DisplayName0, p.Version0, c.software_X, c.release_X, c.title_X, c.cpe_name,
  {_java_sql('c.cpe23', 'c.vendor_X', 'c.software_X', 'c.release_X')} AS rel_tmp FROM products p JOIN cpe c ON p.vendor_X = c.vendor_X
  WHERE p.vendor_X <> 'microsoft' AND NOT (p.vendor_X = 'cisco' AND p.Version0 = '-'
   AND contains(lower(p.DisplayName0), 'webex')))
SELECT vendor_X, DisplayName0, Version0, software_X, release_X, cpe_name, CAST(1 AS BIGINT) AS n FROM cj
 WHERE NOT """ + _NO_VERSION + """ AND (rel_tmp = Version0 OR (least(length(rel_tmp), length(Version0)) > 0
  AND (CASE WHEN length(rel_tmp) <= length(Version0) THEN contains(Version0, rel_tmp) ELSE contains(rel_tmp, Version0) END)
  AND floor(100.0 * (2.0 * least(length(rel_tmp), length(Version0))
   / (least(length(rel_tmp), length(Version0)) + greatest(length(rel_tmp), length(Version0)))) + 0.5) >= 90))
 UNION ALL SELECT vendor_X, NULL, NULL, NULL, NULL, NULL, count(*) FILTER (WHERE """ + _NO_VERSION + """)
 FROM cj GROUP BY vendor_X""")


@register("version_gate", _VG_BRUTE)
def _version_gate(s, d):
    """Versioned pairs that pass, and per vendor the number of pairs that pass for want of a version."""
    products, cpe = CA.pair_skip_rules(I.products(s, d)), I.catalogue(s, d)
    pairs = CA.versioned_pairs(products, cpe).select(
        "vendor_X", "DisplayName0", "Version0", "software_X", "release_X", "cpe_name", F.lit(1).cast("long").alias("n"))
    return pairs.unionByName(CA.ungated_counts(products, cpe), allowMissingColumns=True)


def software_candidates(s, d):
    return CA.software_candidates(I.products(s, d), I.catalogue(s, d))


# brute force: every same-vendor pair, the version gate as a predicate, the
# title gate by the SQL scorer over the distinct (title, display) strings
_SC_SQL = (f""", sp AS (SELECT * FROM products WHERE vendor_X <> 'microsoft' AND NOT (vendor_X = 'cisco'
  AND Version0 = '-' AND contains(lower(DisplayName0), 'webex'))),
 sc AS (SELECT *, {_java_sql('cpe23', 'vendor_X', 'software_X', 'release_X')} AS rel_tmp FROM cpe WHERE title_X IS NOT NULL),
 pr AS (SELECT p.vendor_X, p.DisplayName0, p.Version0, c.software_X, c.release_X, c.rel_tmp, c.title_X, c.cpe_name,
   replace(lower(c.title_X), c.vendor_X, ' ') AS ta, replace(lower(p.DisplayName0), c.vendor_X, ' ') AS tb
  FROM sp p JOIN sc c ON p.vendor_X = c.vendor_X
  WHERE c.rel_tmp = '-' OR p.Version0 = '-' OR c.rel_tmp = p.Version0 OR (least(length(c.rel_tmp), length(p.Version0)) > 0
   AND (CASE WHEN length(c.rel_tmp) <= length(p.Version0) THEN contains(p.Version0, c.rel_tmp) ELSE contains(c.rel_tmp, p.Version0) END)
   AND floor(100.0 * (2.0 * least(length(c.rel_tmp), length(p.Version0))
    / (least(length(c.rel_tmp), length(p.Version0)) + greatest(length(c.rel_tmp), length(p.Version0)))) + 0.5) >= 90)),
 tt AS (SELECT DISTINCT ta, tb FROM pr)
""" + _staged("tt", "ta", "tb", "w_"))
_WSC = Q.scores("ta", "tb", "w_")
_SC_SQL += f""", ts AS (SELECT ta, tb, {_WSC['ratio']} AS fz_ratio, {_WSC['partial']} AS fz_ptl_ratio,
 {_WSC['ptl_token_set']} AS fz_tok_set_ratio, {_WSC['token_sort']} AS fz_ptl_tok_sort_ratio,
 {_WSC['weighted']} AS fz_uwratio FROM w_s2),
 sw AS (SELECT pr.vendor_X, pr.software_X, pr.title_X, pr.DisplayName0, pr.release_X, pr.Version0, ts.fz_ratio,
  ts.fz_ptl_ratio, ts.fz_tok_set_ratio, ts.fz_ptl_tok_sort_ratio, ts.fz_uwratio,
  {Q.ratio('pr.rel_tmp', 'pr.Version0')} AS fz_rel_ratio, {Q.partial_ratio('pr.rel_tmp', 'pr.Version0')} AS fz_rel_ptl_ratio,
  pr.cpe_name AS t_cve_name, CAST(length(pr.title_X) AS INTEGER) AS titlX_len,
  CAST(length(pr.DisplayName0) AS INTEGER) AS DsplyNm0_len
  FROM pr JOIN ts ON pr.ta = ts.ta AND pr.tb = ts.tb WHERE ts.fz_tok_set_ratio >= 70)
"""

register("software_candidates", _SC_SQL + "SELECT * FROM sw")(software_candidates)
register("pair_project", _SC_SQL + f"SELECT {', '.join(K.SOFTWARE_KEYS)}, t_cve_name FROM sw")(
    lambda s, d: software_candidates(s, d).select(*K.SOFTWARE_KEYS, "t_cve_name"))


# --- classification (rows-only checks) -------------------------------------------------

def vendor_model(s, d):
    return CL.train(_vendor_training(s, d), K.VENDOR_FEATURES, K.VENDOR_FOREST)


def software_model(s, d):
    """Trained on the labelled candidates, whose features are those that ``classify`` sees (JDK / JRE releases fixed)."""
    cands = materialize(software_candidates(s, d), "software_candidates")
    lab = CL.split_labelled(CL.label_lookup(cands, I.software_labels(s, d), K.SOFTWARE_KEYS))[1]
    return CL.train(lab, K.SOFTWARE_FEATURES, K.SOFTWARE_FOREST)


@register("train_vendor")
def _train_vendor(s, d):
    model = vendor_model(s, d)
    rf = model.stages[-1]
    return s.createDataFrame([(i, float(v)) for i, v in enumerate(rf.featureImportances.toArray())],
                             "feature_idx int, importance double")


@register("train_software")
def _train_software(s, d):
    model = software_model(s, d)
    rf = model.stages[-1]
    return s.createDataFrame([(i, float(v)) for i, v in enumerate(rf.featureImportances.toArray())],
                             "feature_idx int, importance double")


def _vendor_unlabelled(s, d):
    return CL.split_labelled(CL.pair_complete(_vendor_looked(s, d), K.VENDOR_KEYS + K.VENDOR_FEATURES))


_UNL_SQL = _VEN_CANDS + _VLAB + """, unl AS (SELECT vc.* FROM vc LEFT JOIN vl ON vc.publisher0 = vl.publisher0
 AND vc.vendor_X = vl.vendor_X WHERE vl.match IS NULL), lab AS (SELECT vc.publisher0, vc.vendor_X, vl.match
 FROM vc JOIN vl ON vc.publisher0 = vl.publisher0 AND vc.vendor_X = vl.vendor_X)\n"""
_RULE_SQL = "CASE WHEN fz_uwratio >= 80 THEN 1 ELSE 0 END"


def _by_rule(unl):
    """A match column by a fixed rule in place of the forest's, so that SQL can follow."""
    return unl.withColumn("match", F.when(F.col("fz_uwratio") >= 80, 1).otherwise(0))


# the forest is not SQL, but the fixture's truth is: an unlabelled candidate only contains the other name
@register("classify", _UNL_SQL + "SELECT publisher0, vendor_X, 0 AS match FROM unl")
def _classify(s, d):
    out = CL.classify(_vendor_unlabelled(s, d)[0], vendor_model(s, d))
    return out.select("publisher0", "vendor_X", "match")


@register("union_matches", _UNL_SQL + f"""SELECT publisher0, vendor_X, {_RULE_SQL} AS match, 0 AS src FROM unl
 UNION ALL SELECT publisher0, vendor_X, match, 1 FROM lab""")
def _union_matches(s, d):
    unl, lab = _vendor_unlabelled(s, d)
    return CL.union_matches(_by_rule(unl), lab).select("publisher0", "vendor_X", "match", F.col("_src").alias("src"))


@register("finalise_matches", _UNL_SQL + f"""SELECT publisher0, vendor_X FROM unl WHERE {_RULE_SQL} = 1
 UNION SELECT publisher0, vendor_X FROM lab WHERE match = 1""")
def _finalise(s, d):
    unl, lab = _vendor_unlabelled(s, d)
    return CL.match_project_vendor(CL.finalise_matches(_by_rule(unl), lab, K.VENDOR_KEYS))


@register("vendor_match")
def _vendor_match(s, d):
    cands = materialize(CA.name_lengths_vendor(vendor_candidates(s, d)), "vendor_candidates")
    return CL.vendor_match(cands, I.vendor_labels(s, d), vendor_model(s, d))


@register("software_match")
def _software_match(s, d):
    # scored candidates feed the labelled and the classified branch: write them once
    cands = materialize(software_candidates(s, d), "software_candidates")
    labels = I.software_labels(s, d)
    # train on the labelled candidates (their features are already computed)
    lab = CL.split_labelled(CL.label_lookup(cands, labels, K.SOFTWARE_KEYS))[1]
    model = CL.train(lab, K.SOFTWARE_FEATURES, K.SOFTWARE_FOREST)
    return CL.software_match(cands, labels, model)


def _vendor_training(s, d):
    looked = CL.pair_complete(_vendor_looked(s, d), K.VENDOR_KEYS + K.VENDOR_FEATURES)
    return materialize(CL.split_labelled(looked)[1])


@register("tune")
def _tune(s, d):
    cvm = CL.tune(_vendor_training(s, d), K.VENDOR_FEATURES, n_candidates=40, folds=3)
    return s.createDataFrame([(i, float(m)) for i, m in enumerate(cvm.avgMetrics)],
                             "candidate int, accuracy double")


@register("compare_models")
def _compare_models(s, d):
    """Nine families: accuracies by cross-validation, or over out-of-fold predictions."""
    pairs = materialize(label_features_software(s, d), "label_features")
    res = CL.compare_models(pairs, K.SOFTWARE_FEATURES)
    out = s.createDataFrame(res, "model string, accuracy double")
    for name, predicted in EV.other_families(pairs, K.SOFTWARE_KEYS, K.SOFTWARE_FEATURES).items():
        out = out.union(EV.confusion(predicted).select(F.lit(name).alias("model"), "accuracy"))
    return out


_FOLDS = 5
# one row per key with its fold, as the evaluation sees the labelled pairs
_ROWS_SQL = ", feat AS (" + _FEAT_SW_SQL.lstrip(", ").replace("lp AS", "WITH lp AS", 1) + f"""),
 lr AS (SELECT *, md5(concat_ws('|', {', '.join(K.SOFTWARE_KEYS)})) AS mark FROM (
  SELECT {', '.join(K.SOFTWARE_KEYS)}, {', '.join(f'max({f}) AS {f}' for f in K.SOFTWARE_FEATURES)}, CAST(max(match) AS INTEGER) AS match
  FROM feat GROUP BY {', '.join(K.SOFTWARE_KEYS)}) g),
 er AS (SELECT *, CAST(CAST('0x' || left(mark, 8) AS BIGINT) % {_FOLDS} AS INTEGER) AS fold FROM lr)
"""
_EVAL_COLS = f"{', '.join(K.SOFTWARE_KEYS)}, match, fold, predicted"


def _rows(s, d):
    return materialize(EV.labelled_rows(label_features_software(s, d), K.SOFTWARE_KEYS, K.SOFTWARE_FEATURES, _FOLDS), "labelled_rows")


def _shown(df):
    return df.select(*K.SOFTWARE_KEYS, "match", "fold", F.col("predicted").cast("int").alias("predicted"))


_AWAY = " + ".join(f"(er.{f} - c.{f}) * (er.{f} - c.{f})" for f in K.SOFTWARE_FEATURES)


@register("centroid_predictions", _ROWS_SQL + f""", cen AS (
  SELECT k AS fold, match, {', '.join(f'avg({f}) AS {f}' for f in K.SOFTWARE_FEATURES)}
  FROM er, range({_FOLDS}) t(k) WHERE er.fold <> k GROUP BY k, match),
 far AS (SELECT er.*, c.match AS cls, {_AWAY} AS away FROM er JOIN cen c ON er.fold = c.fold)
 SELECT {_EVAL_COLS} FROM (SELECT *, cls AS predicted, row_number() OVER (
  PARTITION BY {', '.join(K.SOFTWARE_KEYS)} ORDER BY away, cls) AS rn FROM far) x WHERE rn = 1""")
def _centroids(s, d):
    return _shown(EV.nearest_centroid(_rows(s, d), K.SOFTWARE_FEATURES))


_APART = " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in K.SOFTWARE_FEATURES)


@register("neighbour_predictions", _ROWS_SQL + f""", near AS (
  SELECT a.mark, b.match AS vote, row_number() OVER (PARTITION BY a.mark ORDER BY {_APART}, b.mark) AS rn
  FROM er a JOIN er b ON a.fold <> b.fold),
 votes AS (SELECT mark, CASE WHEN sum(2 * vote - 1) > 0 THEN 1 ELSE 0 END AS predicted FROM near WHERE rn <= {EV.NEIGHBOURS} GROUP BY mark)
 SELECT {_EVAL_COLS} FROM er JOIN votes USING (mark)""")
def _neighbours(s, d):
    return _shown(EV.out_of_fold(_rows(s, d), _FOLDS, lambda t: EV.nearest_neighbours(t, K.SOFTWARE_FEATURES)))


# the fixture's labels can be told apart: a forest that has not seen a fold is nearly always right, a constant answer is not
@register("evaluate_software", _ROWS_SQL + """ SELECT fold, count(*) AS n, sum(match) AS positive, sum(1 - match) AS negative,
 true AS good FROM er GROUP BY fold""")
def _evaluate_software(s, d):
    """The software forest over out-of-fold predictions: nine of ten pairs and more told right in every fold, however
    small; the larger class holds eight of ten at most."""
    def fit(train):
        model = CL.train(train, K.SOFTWARE_FEATURES, K.SOFTWARE_FOREST)

        def add(rows):
            told = CL.classify(rows.withColumnRenamed("match", "truth"), model)
            return told.withColumnRenamed("match", "predicted").withColumnRenamed("truth", "match")
        return add

    found = EV.confusion(EV.out_of_fold(_rows(s, d), _FOLDS, fit), ["fold"])
    return found.select("fold", "n", (F.col("tp") + F.col("fn")).alias("positive"), (F.col("fp") + F.col("tn")).alias("negative"),
                        (F.col("accuracy") >= 0.9).alias("good"))


@register("save_model", f"SELECT CAST(feature_idx AS INTEGER) AS feature_idx, true AS same FROM range({len(K.VENDOR_FEATURES)}) "
          "t(feature_idx) WHERE EXISTS (SELECT 1 FROM part)")
def _save_model(s, d):
    """The stored forest holds the importances of the one in memory."""
    model = vendor_model(s, d)
    stored = CL.load_model(CL.save_model(model, scratch_path(s, "vendor_model")))
    pairs = zip(model.stages[-1].featureImportances.toArray(), stored.stages[-1].featureImportances.toArray())
    return s.createDataFrame([(i, bool(a == b)) for i, (a, b) in enumerate(pairs)], "feature_idx int, same boolean")


@register("load_model", _UNL_SQL + "SELECT publisher0, vendor_X, true AS same FROM unl")
def _load_model(s, d):
    """Every unlabelled pair gets the same verdict from the model in memory and from the stored one."""
    model, unl = vendor_model(s, d), _vendor_unlabelled(s, d)[0]
    stored = CL.load_model(CL.save_model(model, scratch_path(s, "vendor_model")))
    keys = ["publisher0", "vendor_X"]
    a, b = (CL.classify(unl, m).select(*keys, F.col("match").alias(n)) for m, n in ((model, "a"), (stored, "b")))
    return a.join(b, keys).select(*keys, (F.col("a") == F.col("b")).alias("same"))


@register("pipeline_run")
def _pipeline_run(s, d):
    """The whole batch run (fuzzy matching with the trained forests) -> top 25 High."""
    from ..operators import enrich as E
    from .fixtures import fixture
    from .pipeline import Inputs, run
    inp = Inputs(hosts=fixture(s, d, "f_hosts"), software=fixture(s, d, "f_inventory"),
                 cpe=fixture(s, d, "f_cpe"), cve=fixture(s, d, "f_cve"),
                 vendor_labels=I.vendor_labels(s, d), software_labels=I.software_labels(s, d))
    regions, group = fixture(s, d, "f_site_regions"), fixture(s, d, "f_ad_group")
    out = run(s, inp, scratch_path(s, "pipeline"), enrich=lambda h: E.enrich_hosts(h, regions, group),
              reports=E.custom_reports)
    return out["top25_sft_high"]
