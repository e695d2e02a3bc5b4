"""Queries of rule evaluation, stability, uncertainty and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ardoise.functions.columns import half_up, percent, wald, wilson
from ardoise.operators import evaluation as E
from ardoise.operators import linking as L
from ardoise.operators import models as M
from ardoise.operators.layers import current
from ardoise.operators.prefix import ranked
from ardoise.plans import oracle as O
from ardoise.plans.linking import _C as _LEVELS
from ardoise.session import materialise, table

THRESHOLDS = [2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 6.0]
SPLIT = 2020


def _judged(spark, d):
    return E.judged(table(spark, d, "marches"))


def _scored(spark, d):
    x = _judged(spark, d)
    return E.scored(x, E.references(x))


def detection_seuils(spark, d):
    """AGG-20: three directions by seven thresholds."""
    return E.threshold_grid(_scored(spark, d), THRESHOLDS)


def detection_par_annee(spark, d):
    """AGG-23."""
    return E.by_year(_scored(spark, d), 4.0)


def _periods(spark, d):
    x = _judged(spark, d)
    return x, E.references(x.filter(F.col("annee") <= SPLIT)), E.references(x.filter(F.col("annee") > SPLIT))


def stabilite_hors_echantillon(spark, d):
    """AGG-22: references learned before, judged after."""
    x, old, _ = _periods(spark, d)
    return E.by_year(E.scored(x.filter(F.col("annee") > SPLIT), old), 4.0)


def stabilite_derive(spark, d):
    """AGG-24, JOI-4, SRT-12."""
    _, old, new = _periods(spark, d)
    return E.drift(old, new)


def stabilite_desaccords(spark, d):
    """AGG-25, JOI-3: by contract number (rows multiply) and by row."""
    x, old, new = _periods(spark, d)
    after = x.filter(F.col("annee") > SPLIT)
    a, b = E.scored(after, old), E.scored(after, new)
    return E.disagreement(a, b, ["marche_id"], 4.0).select(F.lit("contrat").alias("cle"), "*").unionByName(E.disagreement(a, b, ["id"], 4.0).select(F.lit("ligne").alias("cle"), "*"))


def precision_au_budget(spark, d):
    """STT-8, STT-10, SRT-10: rule, and score oriented towards high prices."""
    x = _scored(spark, d).withColumn("oriente", F.when(F.col("z") > 0, F.col("z") * F.col("z")).otherwise(F.lit(float("-inf"))))
    out = [E.precision_at(x, s, [10, 50, 100, 200]).withColumn("methode", F.lit(n)) for s, n in (("z", "regle"), ("oriente", "oriente"))]
    return out[0].unionByName(out[1])


def scores_globaux(spark, d):
    """STT-12: global, family and robust scores side by side (largest distance each)."""
    x = _scored(spark, d)
    whole = x.agg(F.avg("l").alias("m"), F.stddev_samp("l").alias("s"))
    fam = x.groupBy("famille_cpv").agg(F.avg("l").alias("fm"), F.stddev_samp("l").alias("fs"))
    y = x.crossJoin(F.broadcast(whole)).join(F.broadcast(fam), "famille_cpv")
    return y.groupBy("famille_cpv").agg(half_up(F.max((F.col("l") - F.col("m")) / F.col("s")), 4).alias("global"), half_up(F.max((F.col("l") - F.col("fm")) / F.col("fs")), 4).alias("famille"), half_up(F.max("z"), 4).alias("robuste"))


FEATURES = ["l", "z", "duree_mois", "offres_recues", "l_par_mois"]


def jeu_du_modele(spark, d):
    """STT-11: the five features of the model, missing ones 0."""
    x = _scored(spark, d).select("id", "l", "z", "juste").join(table(spark, d, "marches").select("id", "montant", "duree_mois", "offres_recues"), "id")
    months = F.when(F.col("duree_mois") > 0, F.round(F.log10(F.col("montant") / F.col("duree_mois")), 4)).otherwise(F.col("l"))
    return x.select("id", "l", "z", "juste", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("duree_mois", "offres_recues")], months.alias("l_par_mois"))


def foret_isolement(spark, d):
    """STT-7: isolation forest, every row scored."""
    return E.isolation_scores(jeu_du_modele(spark, d), FEATURES)


def grille_foret(spark, d):
    """STT-14: six settings of the forest; precision of the thousand highest scores, free and kept to high prices."""
    x = materialise(jeu_du_modele(spark, d), "jeu")
    out = None
    for trees, rows in ((50, 256), (100, 64), (100, 256), (100, 1024), (100, 4096), (300, 256)):
        y = materialise(x.join(E.isolation_scores(x, FEATURES, trees=trees, tree_rows=rows), "id").withColumn("oriente", F.when(F.col("z") > 0, F.col("score")).otherwise(F.lit(float("-inf")))), "grille")
        free, kept = (E.precision_at(y, s, [1000]).select(F.col("precision").alias(s)) for s in ("score", "oriente"))
        one = free.crossJoin(F.broadcast(kept)).select(F.lit(trees).alias("arbres"), F.lit(rows).alias("echantillon"), F.col("score").alias("libre"), "oriente")
        out = one if out is None else out.unionByName(one)
    return out


def kmeans_distance(spark, d):
    """STT-12: distance to the nearest of twelve centres, after scaling by mean and deviation, and by median and quartiles."""
    x = materialise(jeu_du_modele(spark, d), "jeu")
    a, b = (M.kmeans_scores(materialise(M.scaled(x, FEATURES, robust), "echelle"), FEATURES) for robust in (False, True))
    return a.withColumnRenamed("score", "standard").join(b.withColumnRenamed("score", "robuste"), "id")


def _robust(spark, d):
    return materialise(M.scaled(jeu_du_modele(spark, d), FEATURES, True), "jeu-robuste")


def acp_reconstruction(spark, d):
    """STT-12: error of reconstruction from two principal components."""
    return M.reconstruction_scores(_robust(spark, d), FEATURES)


def enveloppe_elliptique(spark, d):
    """STT-12: Mahalanobis distance from the nine tenths nearest to the middle."""
    return M.ellipse_scores(_robust(spark, d), FEATURES)


def machine_une_classe(spark, d):
    """STT-12: linear one-class machine."""
    return M.one_class_scores(_robust(spark, d), FEATURES)


def facteur_local(spark, d):
    """STT-12: local outlier factor against a bounded sample."""
    return M.local_outlier_scores(_robust(spark, d), FEATURES)


def banc_modeles(spark, d):
    """STT-12: ten methods on the same rows: areas under both curves, precision of the highest scores."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    x = materialise(jeu_du_modele(spark, d).join(_scored(spark, d).select("id", "famille_cpv"), "id"), "jeu")
    standard, robust = (materialise(M.scaled(x, FEATURES, r), "echelle") for r in (False, True))
    fam = x.groupBy("famille_cpv").agg(F.avg("l").alias("m"), F.stddev_samp("l").alias("s"))
    methods = {
        "global": x.select("id", F.col("l").alias("score")), "famille": x.join(F.broadcast(fam), "famille_cpv").select("id", ((F.col("l") - F.col("m")) / F.col("s")).alias("score")), "regle": x.select("id", F.col("z").alias("score")),
        "k-moyennes standard": M.kmeans_scores(standard, FEATURES), "k-moyennes robuste": M.kmeans_scores(robust, FEATURES), "composantes": M.reconstruction_scores(robust, FEATURES), "enveloppe": M.ellipse_scores(robust, FEATURES),
        "une classe": M.one_class_scores(robust, FEATURES), "foret": E.isolation_scores(x, FEATURES), "facteur local": M.local_outlier_scores(robust, FEATURES),
    }
    out = None
    for name, score in methods.items():
        y = materialise(x.select("id", "juste", F.col("juste").cast("double").alias("label")).join(score, "id").fillna(0.0, ["score"]), "scores")
        area = {m: float(BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName=m, numBins=1000).evaluate(y)) for m in ("areaUnderROC", "areaUnderPR")}
        at = E.precision_at(y, "score", [100, 1000, 10_000]).groupBy().pivot("budget", [100, 1000, 10_000]).agg(F.first("precision"))
        one = at.select(F.lit(name).alias("methode"), F.lit(round(area["areaUnderROC"], 4)).alias("roc"), F.lit(round(area["areaUnderPR"], 4)).alias("precision_rappel"), *[F.col(str(b)).alias(f"p{b}") for b in (100, 1000, 10_000)])
        out = one if out is None else out.unionByName(one)
    return out


def auc_methodes(spark, d):
    """STT-12: areas under the ROC curve and the precision-recall curve of three scores."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    x = materialise(_scored(spark, d).select("z", "l", F.abs("z").alias("distance"), F.col("juste").cast("double").alias("label")), "scores")
    rows = []
    for s in ("z", "l", "distance"):
        area = lambda metric, s=s: float(BinaryClassificationEvaluator(rawPredictionCol=s, labelCol="label", metricName=metric, numBins=0).evaluate(x))
        rows.append((s, round(area("areaUnderROC"), 4), round(area("areaUnderPR"), 4)))
    return spark.createDataFrame(rows, "methode string, roc double, precision_rappel double")


def aleatoire(spark, d):
    """STT-9: seeded random baseline."""
    return _scored(spark, d).select("id", F.rand(42).alias("score"))


def tirage_pondere(spark, d, n: int = 110, seed: int = 42):
    """STT-13: draws with replacement, a supplier as often as it has contracts: each draw is a place in the running sum of the weights."""
    import numpy as np

    x = ranked(table(spark, d, "marches").filter("length(titulaire_siret) = 14").groupBy("titulaire_siret").agg(F.count(F.lit(1)).alias("poids")), [F.col("titulaire_siret")], "poids")
    x = materialise(x, "poids")
    total = x.agg(F.sum("poids")).first()[0] or 0
    drawn = spark.createDataFrame([(k, int(u)) for k, u in enumerate(np.random.default_rng(seed).integers(0, total, n if total else 0))], "tirage int, place long")
    # n places against all weights.
    return x.join(F.broadcast(drawn), (F.col("place") < F.col("cumul")) & (F.col("place") >= F.col("cumul") - F.col("poids"))).select("tirage", "titulaire_siret", "poids")


def _verdict_counts(spark, d):
    v = table(spark, d, "verdicts_rapprochement").filter("verdict_humain in ('oui', 'non')")
    return v.groupBy("tranche").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict_humain") == "oui").alias("k"))


def intervalles_wilson_wald(spark, d):
    """STT-1, STT-2."""
    lo, hi = wilson(F.col("k"), F.col("n"))
    a, b = wald(F.col("k"), F.col("n"))
    return _verdict_counts(spark, d).select("tranche", "n", "k", half_up(lo, 4).alias("wilson_bas"), half_up(hi, 4).alias("wilson_haut"), half_up(a, 4).alias("wald_bas"), half_up(b, 4).alias("wald_haut"))


def intervalles_exacts(spark, d):
    """STT-3."""
    x = E.exact_intervals(_verdict_counts(spark, d), "k", "n")
    return x.select("tranche", "n", "k", F.round("bas", 4).alias("bas"), F.round("haut", 4).alias("haut"))


def _strata(spark, d):
    """Judged pairs by band of similarity (a fixed number of bands, judged by hand), and how many notices each band really has."""
    rows = table(spark, d, "verdicts_rapprochement").filter("verdict_humain in ('oui', 'non') and tranche is not null").groupBy("tranche", "verdict_humain").agg(F.count(F.lit(1)).alias("n")).collect()
    labels: dict[str, list[bool]] = {}
    for r in sorted(rows):
        labels.setdefault(r.tranche, []).extend([r.verdict_humain == "oui"] * r.n)
    band = F.floor(F.least(F.round(F.col("similarite") * 10, 6), F.lit(9.0))).cast("int")
    found = L.levels(table(spark, d, "avis"), table(spark, d, "marches")).filter("similarite is not null").groupBy(band.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    return labels, {f"{r.b / 10:.1f} a {(r.b + 1) / 10:.1f}": r.n for r in found}


BANDS = [f"{k / 10:.1f} a {(k + 1) / 10:.1f}" for k in range(10)]


def justesse_ponderee(spark, d):
    """STT-4: for each lower bound the accuracy weighted by the real sizes of the bands; null where a kept band has no verdict."""
    labels, sizes = _strata(spark, d)
    out = []
    for k in range(10):
        kept = [s for s in BANDS[k:] if sizes.get(s)]
        a = E.weighted_accuracy(labels, sizes, kept)
        out.append((k / 10, sum(sizes.get(s, 0) for s in kept), None if a is None else round(100 * a, 4)))
    return spark.createDataFrame(out, "seuil double, avis long, justesse double")


def bootstrap_stratifie(spark, d):
    """STT-5, STT-18: 100 to 50,000 draws with two seeds, the bounds and their gap; a sample without variation is marked."""
    labels, sizes = _strata(spark, d)
    weights = {s: float(sizes.get(s, 0)) for s in labels}
    if not any(weights.values()):
        return spark.createDataFrame([], "tirages int, graine int, bas double, haut double, largeur double, degenere boolean")
    out = []
    for draws in (100, 1_000, 10_000, 50_000):
        for seed in (E.BOOTSTRAP_SEED, 7):
            low, high, flat = E.stratified_bootstrap(labels, weights, draws, seed)
            out.append((draws, seed, low, high, high - low, flat))
    return spark.createDataFrame(out, "tirages int, graine int, bas double, haut double, largeur double, degenere boolean")


def sources_incertitude(spark, d):
    """STT-6: every published figure with what its uncertainty comes from, how many cases it rests on, and its interval."""
    v = table(spark, d, "verdicts_rapprochement").filter("verdict_humain in ('oui', 'non')")
    m = current(table(spark, d, "marches"))
    s = _scored(spark, d)
    share = lambda df, right: df.agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("k"))
    rows = {
        ("justesse du rapprochement", "verdicts lus par une personne"): share(v, F.col("verdict_humain") == "oui"),
        ("concordance du titulaire", "verdicts lus par une personne"): share(v.filter("titulaire_concorde = 'oui'"), F.col("verdict_humain") == "oui"),
        ("avis relies", "tirage des avis"): share(L.levels(table(spark, d, "avis"), table(spark, d, "marches")), F.col("niveau") >= 3),
        ("precision de la regle de prix", "etiquette du producteur"): share(s.filter("z > 4"), F.col("juste")),
        ("rappel de la regle de prix", "etiquette du producteur"): share(s.filter("juste"), F.col("z") > 4),
        ("part des PME", "categories absentes"): share(m.filter("titulaire_categorie is not null"), F.col("titulaire_categorie") == "PME"),
        ("offres uniques", "nombres d'offres absents"): share(m.filter("offres_recues is not null"), F.col("offres_recues") == 1),
    }
    out = None
    for (figure, source), df in rows.items():
        lo, hi = wilson(F.col("k"), F.col("n"))
        one = df.select(F.lit(figure).alias("mesure"), F.lit(source).alias("origine"), "n", "k", half_up(lo, 4).alias("bas"), half_up(hi, 4).alias("haut"))
        out = one if out is None else out.unionByName(one)
    return out


def recensement_pme(spark, d):
    """AGG-26: share of small firms over resolved awards, with the bounds of what is unresolved."""
    x = current(table(spark, d, "marches")).filter("marche_id is not null")
    one = x.agg(F.count(F.lit(1)).alias("total"), F.count("titulaire_categorie").alias("resolus"), F.count_if(F.col("titulaire_categorie") == "PME").alias("pme"))
    any_ = x.groupBy("marche_id").agg(F.sum(F.when(F.col("titulaire_categorie") == "PME", 1).otherwise(0)).alias("p")).agg(F.count_if(F.col("p") > 0).alias("contrats_pme"), F.count(F.lit(1)).alias("contrats"))
    y = one.crossJoin(F.broadcast(any_))
    return y.select("total", "resolus", "pme", "contrats_pme", "contrats", half_up(percent(F.col("pme"), F.col("resolus")), 4).alias("part"), half_up(percent(F.col("pme"), F.col("total")), 4).alias("part_basse"), half_up(percent(F.col("pme") + F.col("total") - F.col("resolus"), F.col("total")), 4).alias("part_haute"))


def statistiques_servies(spark, d):
    """AGG-4..7, JOI-8, SNK-8: the one-row table of served statistics."""
    x = current(table(spark, d, "marches")).filter("marche_id is not null and montant between 0 and 1e9")
    cents = F.round(F.col("montant") * 100).cast("long")
    a = x.agg(F.count(F.lit(1)).alias("lignes"), F.count_distinct("marche_id").alias("contrats"), F.count_distinct("acheteur_siret").alias("acheteurs"), F.sum(cents).alias("centimes"), half_up(percent(F.count_if("offre_unique"), F.count("offre_unique")), 4).alias("part_offre_unique"))
    b = x.select("marche_id", cents.alias("c")).distinct().agg(F.sum("c").alias("centimes_sans_doublons"))
    s = table(spark, d, "signaux").agg(F.count_if(F.col("signaux_forts") > 0).alias("signales"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(s))


def cout_enrichissement(spark, d):
    """STT-20: distinct buyers plus distinct suppliers, at a delay each."""
    x = table(spark, d, "marches").agg((F.count_distinct("acheteur_siret") + F.count_distinct("titulaire_siret")).alias("appels"))
    return x.withColumn("heures", half_up(F.col("appels") * 0.15 / 3600, 6))


_J = "j as (select id, marche_id, famille_cpv, annee, round(log10(montant), 4) as l, montant_anomalie is not null as juste from marches where donneesActuelles and montant > 0 and montant <= 1e12 and famille_cpv is not null)"


# Exact bounds by fifty halvings: where the upper or lower tail of the binomial reaches 2.5 %.
_TAIL = "list_sum(list_transform(range({0}, {1}), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(m) + (n - i) * ln(1 - m))))"
_HALVE = "{0}(tranche, n, k, a, b, s) as (select tranche, n, k, 0.0::double, 1.0::double, 0 from v union all select tranche, n, k, case when {1} then a else m end, case when {1} then m else b end, s + 1 from (select *, (a + b) / 2 as m from {0}) x where s < 50)"
_EXACT_INTERVALS = (
    "with recursive v as (select tranche, count(*) as n, count(*) filter (where verdict_humain = 'oui') as k from verdicts_rapprochement where verdict_humain in ('oui', 'non') group by 1), "
    + _HALVE.format("lo", _TAIL.format("k", "n + 1") + " > 0.025") + ", " + _HALVE.format("hi", _TAIL.format("0", "k + 1") + " < 0.025")
    + " select v.tranche, v.n, v.k, case when v.k = 0 then 0.0 else round(50 * (lo.a + lo.b), 4) end as bas, case when v.k = v.n then 100.0 else round(50 * (hi.a + hi.b), 4) end as haut from v join lo on lo.tranche is not distinct from v.tranche and lo.s = 50 join hi on hi.tranche is not distinct from v.tranche and hi.s = 50"
)


def _ref(name: str, where: str) -> str:
    return f"{name} as (select famille_cpv, count(*) as n, median(l) as mediane, quantile_cont(l, 0.25) as q1, quantile_cont(l, 0.75) as q3 from j where {where} group by 1 having count(*) >= 30 and quantile_cont(l, 0.75) > quantile_cont(l, 0.25))"


def _sc(name: str, ref: str, where: str = "true") -> str:
    return f"{name} as (select j.*, round((l - mediane) / ((q3 - q1) / 1.349), 6) as z from j join {ref} using (famille_cpv) where {where})"


_S = f"with {_J}, {_ref('r', 'true')}, {_sc('s', 'r')}"
_P = f"with {_J}, {_ref('o', f'annee <= {SPLIT}')}, {_ref('n', f'annee > {SPLIT}')}, {_sc('a', 'o', f'annee > {SPLIT}')}, {_sc('b', 'n', f'annee > {SPLIT}')}"


def _year(t: str) -> str:
    return f"select annee, count(*) as lignes, count(*) filter (where z > 4) as signales, count(*) filter (where z > 4 and juste) as justes, {O.half('100.0 * count(*) filter (where z > 4 and juste) / nullif(count(*) filter (where z > 4), 0)', 4)} as precision, {O.half('100.0 * count(*) filter (where z > 4 and juste) / nullif(count(*) filter (where juste), 0)', 4)} as rappel, {O.half('100.0 * count(*) filter (where z > 4) / count(*)', 4)} as part from {t} group by annee"


def _dis(key: str, label: str) -> str:
    return f"select '{label}' as cle, count(*) as compares, count(*) filter (where fa and fb) as deux, count(*) filter (where fa and not fb) as premier, count(*) filter (where not fa and fb) as second, {O.half('100.0 * count(*) filter (where fa <> fb) / nullif(count(*) filter (where fa or fb), 0)', 4)} as part_union from (select a.z > 4 as fa, b.z > 4 as fb from a join b using ({key}))"


def _top(score: str, name: str) -> str:
    return " union all ".join(f"select {b} as budget, case when (select count(*) from s) >= {b} then {O.half(f'100.0 * count(*) filter (where juste) / {b}', 4)} else 0.0 end as precision, '{name}' as methode from (select juste from s order by {score} desc, id limit {b})" for b in (10, 50, 100, 200))


_W = "{c} * ((k / n + z2 / (2.0 * n)) / (1 + z2 / n) {s} 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + z2 / (4.0 * n * n)) / (1 + z2 / n))"
ORACLES = {
    "detection_seuils": _S + " select sens, seuil, signales, justes, " + O.half("100.0 * justes / nullif(signales, 0)", 4) + " as precision, " + O.half("100.0 * justes / nullif(attendus, 0)", 4) + " as rappel from (" + " union all ".join(f"select '{w}' as sens, {t} as seuil, count(*) filter (where {c}) as signales, count(*) filter (where {c} and juste) as justes, count(*) filter (where juste) as attendus from s" for w, f in (("haut", "z > {t}"), ("bas", "z < -{t}"), ("deux", "abs(z) > {t}")) for t in THRESHOLDS for c in [f.format(t=t)]) + ")",
    "detection_par_annee": f"{_S} {_year('s')}",
    "stabilite_hors_echantillon": f"{_P} {_year('a')}",
    "stabilite_derive": f"{_P} select famille_cpv, {O.half('100.0 * (pow(10.0, n.mediane - o.mediane) - 1)', 2)} as derive from o join n using (famille_cpv)",
    "stabilite_desaccords": f"{_P} {_dis('marche_id', 'contrat')} union all {_dis('id', 'ligne')}",
    "precision_au_budget": f"{_S} select * from (select * from ({_top('z', 'regle')}) union all select * from ({_top('case when z > 0 then z * z else -1e308 end', 'oriente')}))",
    "scores_globaux": f"{_S}, w as (select avg(l) as m, stddev_samp(l) as sd from s), f as (select famille_cpv, avg(l) as fm, stddev_samp(l) as fs from s group by 1) select s.famille_cpv, {O.half('max((l - m) / sd)', 4)} as global, {O.half('max((l - fm) / fs)', 4)} as famille, {O.half('max(z)', 4)} as robuste from s join f using (famille_cpv), w group by 1",
    "jeu_du_modele": f"{_S} select s.id, s.l, s.z, s.juste, coalesce(duree_mois, 0)::double as duree_mois, coalesce(offres_recues, 0)::double as offres_recues, case when duree_mois > 0 then round(log10(montant / duree_mois), 4) else s.l end as l_par_mois from s join marches using (id)",
    "intervalles_exacts": _EXACT_INTERVALS,
    "justesse_ponderee": f"with {_LEVELS}, sz as (select cast(floor(least(round(similarite * 10, 6), 9.0)) as int) as b, count(*) as n from lev where similarite is not null group by 1), v as (select cast(round(10 * cast(substr(tranche, 1, 3) as double)) as int) as b, count(*) as t, count(*) filter (where verdict_humain = 'oui') as k from verdicts_rapprochement where verdict_humain in ('oui', 'non') and tranche is not null group by 1), x as (select g.s, sz.b, sz.n, v.t, v.k from range(0, 10) g(s) left join sz on sz.b >= g.s left join v on v.b = sz.b) select s / 10.0 as seuil, cast(coalesce(sum(n), 0) as bigint) as avis, case when count(b) = count(t) and sum(n) > 0 then round(100 * sum(n * k / t) / sum(n), 4) end as justesse from x group by s",
    "sources_incertitude": f"with {_LEVELS}, {_S.removeprefix('with ')}, cc as ("
    "select 'justesse du rapprochement' as mesure, 'verdicts lus par une personne' as origine, count(*) as n, count(*) filter (where verdict_humain = 'oui') as k from verdicts_rapprochement where verdict_humain in ('oui', 'non') "
    "union all select 'concordance du titulaire', 'verdicts lus par une personne', count(*), count(*) filter (where verdict_humain = 'oui') from verdicts_rapprochement where verdict_humain in ('oui', 'non') and titulaire_concorde = 'oui' "
    "union all select 'avis relies', 'tirage des avis', count(*), count(*) filter (where niveau >= 3) from lev union all select 'precision de la regle de prix', 'etiquette du producteur', count(*), count(*) filter (where juste) from s where z > 4 "
    "union all select 'rappel de la regle de prix', 'etiquette du producteur', count(*), count(*) filter (where z > 4) from s where juste union all select 'part des PME', 'categories absentes', count(*), count(*) filter (where titulaire_categorie = 'PME') from marches where donneesActuelles and titulaire_categorie is not null "
    "union all select 'offres uniques', 'nombres d''offres absents', count(*), count(*) filter (where offres_recues = 1) from marches where donneesActuelles and offres_recues is not null), w as (select *, k / n as p, 1.959963984540054 * 1.959963984540054 as z2 from cc) "
    f"select mesure, origine, n, k, case when n = 0 then 0.0 else {O.half('100 * greatest(0.0, (p + z2 / (2 * n)) / (1 + z2 / n) - 1.959963984540054 * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n))', 4)} end as bas, case when n = 0 then 100.0 else {O.half('100 * least(1.0, (p + z2 / (2 * n)) / (1 + z2 / n) + 1.959963984540054 * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n))', 4)} end as haut from w",
    "intervalles_wilson_wald": "with v as (select tranche, count(*) as n, count(*) filter (where verdict_humain = 'oui') as k, 1.959963984540054 * 1.959963984540054 as z2 from verdicts_rapprochement where verdict_humain in ('oui', 'non') group by 1) select tranche, n, k, "
    + O.half("greatest(0.0, " + _W.format(c="100", s="-") + ")", 4) + " as wilson_bas, " + O.half("least(100.0, " + _W.format(c="100", s="+") + ")", 4) + " as wilson_haut, "
    + O.half("100 * greatest(0.0, k / n - 1.959963984540054 * sqrt(k / n * (1 - k / n) / n))", 4) + " as wald_bas, " + O.half("100 * least(1.0, k / n + 1.959963984540054 * sqrt(k / n * (1 - k / n) / n))", 4) + " as wald_haut from v",
    "recensement_pme": f"with x as (select * from marches where donneesActuelles and marche_id is not null), y as (select count(*) as contrats, count(*) filter (where p) as contrats_pme from (select marche_id, coalesce(bool_or(titulaire_categorie = 'PME'), false) as p from x group by 1)), z as (select count(*) as total, count(titulaire_categorie) as resolus, count(*) filter (where titulaire_categorie = 'PME') as pme from x) select total, resolus, pme, contrats_pme, contrats, {O.half('100.0 * pme / resolus', 4)} as part, {O.half('100.0 * pme / total', 4)} as part_basse, {O.half('100.0 * (pme + total - resolus) / total', 4)} as part_haute from y, z",
    "statistiques_servies": f"with x as (select *, cast(round(montant * 100) as bigint) as c from marches where donneesActuelles and marche_id is not null and montant between 0 and 1e9) select count(*) as lignes, count(distinct marche_id) as contrats, count(distinct acheteur_siret) as acheteurs, sum(c) as centimes, {O.half('100.0 * count(*) filter (where offre_unique) / count(offre_unique)', 4)} as part_offre_unique, (select sum(c) from (select distinct marche_id, c from x)) as centimes_sans_doublons, (select count(*) from signaux where signaux_forts > 0) as signales from x",
    "cout_enrichissement": f"select count(distinct acheteur_siret) + count(distinct titulaire_siret) as appels, {O.half('(count(distinct acheteur_siret) + count(distinct titulaire_siret)) * 0.15 / 3600', 6)} as heures from marches",
}
ORACLES = O.typed(ORACLES)
QUERIES = {n: globals()[n] for n in [*ORACLES, "foret_isolement", "grille_foret", "kmeans_distance", "acp_reconstruction", "enveloppe_elliptique", "machine_une_classe", "facteur_local", "banc_modeles", "auc_methodes", "aleatoire", "tirage_pondere", "bootstrap_stratifie"]}
