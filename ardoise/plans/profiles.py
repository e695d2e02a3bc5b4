"""The named descriptive aggregates and quality measures: a registry of name -> query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ardoise.functions.columns import band, half_up, percent
from ardoise.functions.text import fold
from ardoise.operators.layers import current, family, three_valued_single_bid
from ardoise.operators.prefix import ranked
from ardoise.plans import oracle as O
from ardoise.session import table

AMOUNT_CUTS, AMOUNT_LABELS = [25e3, 90e3, 214e3, 1e6, 1e7], ["1. < 25 k", "2. 25-90 k", "3. 90-214 k", "4. 214 k-1 M", "5. 1-10 M", "6. >= 10 M"]
BID_CUTS, BID_LABELS = [2, 4, 10, 100], ["1", "2-3", "4-9", "10-99", "100+"]
KM_CUTS, KM_LABELS = [10, 50, 150, 500], ["< 10", "10-50", "50-150", "150-500", ">= 500"]


def _n() -> Column:
    return F.count(F.lit(1))


def _whole():
    """A window over aggregated results only: a handful of rows."""
    return Window.partitionBy()


def _all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "marches")


def _now(spark: SparkSession, d: str) -> DataFrame:
    return current(_all(spark, d))


def _share(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return half_up(F.lit(100.0) * c / F.sum(c).over(_whole()), 2)


def montants_tranches(spark, d):
    """PRJ-8, WIN-1: amount bands with their share."""
    x = _now(spark, d).filter("montant > 0").groupBy(band(F.col("montant"), AMOUNT_CUTS, AMOUNT_LABELS).alias("tranche")).agg(_n().alias("marches"))
    return x.withColumn("part", _share("marches"))


def montants_total_annuel(spark, d):
    """FIL-6: gross and cleaned yearly totals."""
    x = _now(spark, d).filter(F.col("date_notification").between("2015-01-01", "2025-12-31"))
    clean = F.when(F.col("montant").between(0.01, 1e9) & F.col("montant_anomalie").isNull(), F.col("montant"))
    return x.groupBy(F.year("date_notification").alias("annee")).agg(_n().alias("marches"), half_up(F.sum("montant") / 1e9, 4).alias("brut"), half_up(F.sum(clean) / 1e9, 4).alias("nettoye"))


def saisonnalite_mensuelle(spark, d):
    """WIN-10: months of the year, and whether a month is above the mean of the months."""
    x = _now(spark, d).filter(F.col("date_notification").between("2015-01-01", "2025-12-31")).groupBy(F.month("date_notification").alias("mois")).agg(_n().alias("marches"))
    return x.withColumn("au_dessus", F.col("marches") > F.avg("marches").over(_whole()))


def acheteurs_categories(spark, d):
    return _now(spark, d).groupBy(F.coalesce("acheteur_categorie", F.lit("(non renseignee)")).alias("categorie")).agg(_n().alias("marches"), half_up(F.median("montant"), 2).alias("mediane"))


def familles_cpv(spark, d, least: int = 50):
    """FIL-8: families with more than ``least`` rows."""
    x = _now(spark, d).groupBy(family(F.col("code_cpv")).alias("famille")).agg(_n().alias("marches"), half_up(F.median("montant"), 2).alias("mediane"))
    return x.filter(F.col("famille").isNotNull() & (F.col("marches") > least))


def offres_recues(spark, d):
    """PRJ-9, AGG-36: bid bands in the order of their least value."""
    x = _now(spark, d).filter("offres_recues > 0").groupBy(band(F.col("offres_recues"), BID_CUTS, BID_LABELS).alias("tranche")).agg(_n().alias("marches"), F.min("offres_recues").alias("_premier"))
    return x.orderBy("_premier").drop("_premier")


def normalisation_nature(spark, d):
    return _now(spark, d).groupBy(F.coalesce("nature", F.lit("(vide)")).alias("nature")).agg(_n().alias("marches"))


def montants_histogramme(spark, d):
    """PRJ-12: quarter bins of the log amount with more than 20 rows."""
    x = _now(spark, d).filter("montant > 0").groupBy((F.floor(F.round(F.log10("montant"), 6) * 4) / 4).alias("classe")).agg(_n().alias("marches"))
    return x.filter("marches > 20")


def _lorenz(spark, d):
    total = _now(spark, d).filter("montant between 1 and 1e9").filter(F.col("titulaire_siret").isNotNull()).groupBy("titulaire_siret").agg(F.sum(F.round(F.col("montant") * 100).cast("long")).alias("total"))
    curve = ranked(total, [F.desc("total"), F.col("titulaire_siret")], "total")
    whole = total.agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("somme"))
    return curve.crossJoin(F.broadcast(whole)).select("rang", half_up(F.lit(100.0) * F.col("rang") / F.col("n"), 4).alias("part_titulaires"), half_up(F.lit(100.0) * F.col("cumul") / F.col("somme"), 4).alias("part_montant"))


def concentration_titulaires(spark, d):
    """WIN-2, WIN-3, WIN-6, MTH-2: points of the Lorenz curve of the suppliers."""
    return _lorenz(spark, d).filter("rang % 50 = 0 or rang <= 10")


def concentration_reperes(spark, d):
    """SRT-15: the points of the curve nearest to 1 % and 10 % of the suppliers."""
    x = _lorenz(spark, d)
    near = lambda t: F.min_by(F.struct("rang", "part_titulaires", "part_montant"), F.struct(F.abs(F.col("part_titulaires") - t), F.col("rang"))).alias(f"p{t}")
    return x.agg(near(1), near(10)).select(F.inline(F.array(*[F.struct(F.lit(t).alias("repere"), F.col(f"p{t}.rang").alias("rang"), F.col(f"p{t}.part_titulaires").alias("part_titulaires"), F.col(f"p{t}.part_montant").alias("part_montant")) for t in (1, 10)])))


def saisonnalite_annee_mois(spark, d):
    return _now(spark, d).filter(F.col("date_notification").between("2015-01-01", "2025-12-31")).groupBy(F.year("date_notification").alias("annee"), F.month("date_notification").alias("mois")).agg(_n().alias("marches"))


def saisonnalite_tableau(spark, d):
    """STT-15: year by month as a table of fixed columns."""
    x = _now(spark, d).filter(F.col("date_notification").between("2015-01-01", "2025-12-31")).select(F.year("date_notification").alias("annee"), F.month("date_notification").alias("m"))
    p = x.groupBy("annee").pivot("m", list(range(1, 13))).agg(F.count(F.lit(1))).na.fill(0)
    return p.select("annee", *[F.col(str(k)).cast("long").alias(f"m{k:02d}") for k in range(1, 13)])


def offre_unique_par_cpv(spark, d, least: int = 30):
    """PRJ-6: share of single bids by family, unknown numbers left out."""
    x = _now(spark, d).select(family(F.col("code_cpv")).alias("famille"), three_valued_single_bid(F.col("offres_recues")).alias("u")).filter("famille is not null and u is not null")
    return x.groupBy("famille").agg(_n().alias("marches"), half_up(percent(F.count_if("u"), _n()), 2).alias("part_offre_unique")).filter(F.col("marches") > least)


COMPLETE = ("marche_id", "uid", "acheteur_siret", "acheteur_nom", "titulaire_siret", "titulaire_nom", "objet", "nature", "code_cpv", "montant", "duree_mois", "offres_recues")


def completude_champs(spark, d):
    """SET-1: completeness of twelve fields, in one pass instead of a union of twelve scans."""
    one = _now(spark, d).agg(_n().alias("total"), *[F.count(c).alias(c) for c in COMPLETE])
    rows = F.array(*[F.struct(F.lit(c).alias("champ"), F.col(c).alias("remplis"), F.col("total").alias("total")) for c in COMPLETE])
    return one.select(F.inline(rows)).withColumn("part", half_up(percent(F.col("remplis"), F.col("total")), 2))


def acheteurs_quartiles(spark, d, least: int = 30):
    """AGG-8, AGG-32: five quantiles by category."""
    x = _now(spark, d).filter("montant > 0 and acheteur_categorie is not null").groupBy("acheteur_categorie").agg(_n().alias("marches"), F.percentile("montant", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias("q"))
    return x.filter(F.col("marches") > least).select("acheteur_categorie", "marches", *[half_up(F.col("q")[k], 2).alias(n) for k, n in enumerate(("p05", "q1", "mediane", "q3", "p95"))])


def geographie_acheteurs(spark, d):
    """PRJ-11: a grid over two rounded coordinates within a box (distance and duration stand for them)."""
    x = _now(spark, d).filter(F.col("distance_km").between(0, 1000) & F.col("duree_mois").between(1, 60))
    return x.groupBy(F.round(F.col("distance_km") / 100.0, 0).alias("x"), F.round(F.col("duree_mois") / 10.0, 0).alias("y")).agg(_n().alias("marches")).filter("marches > 20")


def evolution_mensuelle(spark, d):
    """DAT-2: monthly series."""
    return _now(spark, d).filter(F.col("date_notification").between("2015-01-01", "2025-12-31")).groupBy(F.trunc("date_notification", "MM").alias("mois")).agg(_n().alias("marches"))


def distance_titulaires(spark, d):
    """PRJ-10."""
    x = _now(spark, d).filter("distance_km is not null").groupBy(band(F.col("distance_km"), KM_CUTS, KM_LABELS).alias("tranche")).agg(_n().alias("marches"))
    return x.withColumn("part", _share("marches"))


def offre_unique_par_tranche(spark, d):
    x = _now(spark, d).filter("montant > 0 and offres_recues > 0").groupBy(band(F.col("montant"), AMOUNT_CUTS, AMOUNT_LABELS).alias("tranche"))
    return x.agg(_n().alias("marches"), half_up(percent(F.count_if(F.col("offres_recues") == 1), _n()), 2).alias("part_offre_unique"), half_up(F.median("montant"), 2).alias("mediane"))


def qualite_volume(spark, d):
    """AGG-4: global counts."""
    return _all(spark, d).agg(_n().alias("lignes"), F.count_distinct("uid").alias("uid"), F.count_distinct("acheteur_siret").alias("acheteurs"), F.count_distinct("titulaire_siret").alias("titulaires"), F.min("annee").alias("premiere_annee"), F.max("annee").alias("derniere_annee"))


def qualite_lignes_par_uid(spark, d):
    """AGG-10."""
    x = _all(spark, d).filter("marche_id is not null").groupBy("marche_id").agg(_n().alias("n"))
    return x.agg(_n().alias("contrats"), F.count_if(F.expr("n = 1")).alias("une_ligne"), F.count_if(F.expr("n > 1")).alias("plusieurs"), F.max("n").alias("maximum"))


def qualite_origine_multiples(spark, d):
    """AGG-11: where repeated rows come from."""
    x = _all(spark, d).filter("marche_id is not null").groupBy("marche_id", "modification_id").agg(_n().alias("n"), F.count_distinct("titulaire_nom").alias("t"))
    return x.filter("n > 1").agg(_n().alias("groupes"), F.count_if(F.expr("t = n")).alias("par_titulaire"), F.count_if(F.expr("t = 1")).alias("meme_titulaire"), F.count_if(F.expr("t > 1 and t < n")).alias("melange"))


def qualite_lignes_actuelles(spark, d):
    """AGG-16."""
    return _all(spark, d).agg(F.count_if("donneesActuelles").alias("actuelles"), F.count_distinct(F.when(F.col("donneesActuelles"), F.col("marche_id"))).alias("contrats"), F.count_if(F.expr("not donneesActuelles")).alias("anciennes"))


def qualite_montants(spark, d):
    """AGG-12."""
    m = F.col("montant")
    return _all(spark, d).agg(F.count_if(m.isNull()).alias("absents"), F.count_if(m <= 0).alias("negatifs_ou_nuls"), F.count_if(m > 1e9).alias("geants"), F.min("montant").alias("minimum"), half_up(F.median("montant"), 2).alias("mediane"), F.max("montant").alias("maximum"))


def qualite_anomalies(spark, d):
    """AGG-13."""
    return _all(spark, d).groupBy(F.coalesce("montant_anomalie", F.lit("(aucune)")).alias("anomalie")).agg(_n().alias("lignes"))


def qualite_dates(spark, d):
    """AGG-14, DAT-1: the day that counts as today is fixed."""
    x = F.col("date_notification")
    return _all(spark, d).agg(F.count_if(x.isNull()).alias("absentes"), F.min(x).cast("string").alias("premiere"), F.max(x).cast("string").alias("derniere"), F.count_if(x < "2015-01-01").alias("avant"), F.count_if(x > "2025-12-31").alias("apres"))


def qualite_offres(spark, d):
    """AGG-15."""
    o = F.col("offres_recues")
    return _all(spark, d).agg(F.count_if(o.isNull()).alias("absentes"), F.count_if(o == 0).alias("nulles"), F.count_if(o == 1).alias("uniques"), F.count_if(o > 500).alias("invraisemblables"), F.max(o).alias("maximum"))


def qualite_durees(spark, d):
    """AGG-37."""
    m = F.col("duree_mois")
    return _all(spark, d).agg(F.count_if(m.isNull()).alias("absentes"), F.median(m).cast("double").alias("mediane"), F.count_if(m > 120).alias("longues"), F.max(m).alias("maximum"))


def ids_contradictoires(spark, d):
    """AGG-33: numbers published more than once with different amounts."""
    x = _now(spark, d).filter("marche_id is not null").groupBy("marche_id", "titulaire_nom").agg(_n().alias("n"), F.count_distinct("montant").alias("montants")).filter("n > 1")
    return x.agg(_n().alias("repetes"), F.count_if(F.expr("montants > 1")).alias("contradictoires"))


def dispersion_familles(spark, d):
    """AGG-29, AGG-31: mean, deviation and percentiles of the log amount by family."""
    x = _now(spark, d).filter("montant > 0 and famille_cpv is not null").select("famille_cpv", F.round(F.log10("montant"), 4).alias("l")).groupBy("famille_cpv")
    return x.agg(_n().alias("n"), half_up(F.avg("l"), 4).alias("moyenne"), half_up(F.stddev_samp("l"), 4).alias("ecart_type"), half_up(F.percentile("l", 0.01), 4).alias("p01"), half_up(F.percentile("l", 0.99), 4).alias("p99"))


def correlations(spark, d):
    """AGG-30: correlation of every pair of five variables."""
    v = ["l", "duree_mois", "offres_recues", "distance_km", "mois"]
    x = _now(spark, d).filter("montant > 0 and duree_mois > 0 and offres_recues > 0 and distance_km is not null and mois is not null").withColumn("l", F.round(F.log10("montant"), 4))
    pairs = [(a, b) for i, a in enumerate(v) for b in v[i + 1 :]]
    one = x.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"{a}__{b}"), 6).alias("r")) for a, b in pairs])))


def occurrences_lexemes(spark, d):
    """AGG-34: in how many subjects each word occurs."""
    x = _now(spark, d).select(F.explode(F.array_distinct(F.split(fold(F.col("objet")), " "))).alias("lexeme")).filter("lexeme <> ''")
    return x.groupBy("lexeme").agg(_n().alias("marches"))


_NOW = "from marches where donneesActuelles"
_D = "date_notification between date '2015-01-01' and date '2025-12-31'"
_FAM = "case when regexp_matches(trim(code_cpv), '^[0-9]{2}') then substr(trim(code_cpv), 1, 2) end"


def _band(c: str, cuts: list, labels: list) -> str:
    return "case " + " ".join(f"when {c} < {k} then '{v}'" for k, v in zip(cuts, labels)) + f" else '{labels[-1]}' end"


_LOR = f"t as (select titulaire_siret, sum(cast(round(montant * 100) as bigint)) as total {_NOW} and montant between 1 and 1e9 and titulaire_siret is not null group by 1), l0 as (select row_number() over w as rang, 100.0 * row_number() over w / count(*) over () as a, 100.0 * sum(total) over (order by total desc, titulaire_siret rows unbounded preceding) / sum(total) over () as b from t window w as (order by total desc, titulaire_siret)), lor as (select rang, {O.half('a', 4)} as part_titulaires, {O.half('b', 4)} as part_montant from l0)"
ORACLES = {
    "montants_tranches": f"select tranche, marches, {O.half('100.0 * marches / sum(marches) over ()', 2)} as part from (select {_band('montant', AMOUNT_CUTS, AMOUNT_LABELS)} as tranche, count(*) as marches {_NOW} and montant > 0 group by 1)",
    "montants_total_annuel": f"select year(date_notification) as annee, count(*) as marches, {O.half('sum(montant) / 1e9', 4)} as brut, {O.half('sum(case when montant between 0.01 and 1e9 and montant_anomalie is null then montant end) / 1e9', 4)} as nettoye {_NOW} and {_D} group by 1",
    "saisonnalite_mensuelle": f"select mois, marches, marches > avg(marches) over () as au_dessus from (select month(date_notification) as mois, count(*) as marches {_NOW} and {_D} group by 1)",
    "acheteurs_categories": f"select coalesce(acheteur_categorie, '(non renseignee)') as categorie, count(*) as marches, {O.half('median(montant)', 2)} as mediane {_NOW} group by 1",
    "familles_cpv": f"select famille, count(*) as marches, {O.half('median(montant)', 2)} as mediane from (select {_FAM} as famille, montant {_NOW}) where famille is not null group by 1 having count(*) > 50",
    "offres_recues": f"select {_band('offres_recues', BID_CUTS, BID_LABELS)} as tranche, count(*) as marches {_NOW} and offres_recues > 0 group by 1",
    "normalisation_nature": f"select coalesce(nature, '(vide)') as nature, count(*) as marches {_NOW} group by 1",
    "montants_histogramme": f"select floor(round(log10(montant), 6) * 4) / 4 as classe, count(*) as marches {_NOW} and montant > 0 group by 1 having count(*) > 20",
    "concentration_titulaires": f"with {_LOR} select * from lor where rang % 50 = 0 or rang <= 10",
    "concentration_reperes": f"with {_LOR} select r as repere, rang, part_titulaires, part_montant from (select r, lor.*, row_number() over (partition by r order by abs(part_titulaires - r), rang) as k from lor, (values (1), (10)) v(r)) where k = 1",
    "saisonnalite_annee_mois": f"select year(date_notification) as annee, month(date_notification) as mois, count(*) as marches {_NOW} and {_D} group by 1, 2",
    "saisonnalite_tableau": "select year(date_notification) as annee, " + ", ".join(f"count(*) filter (where month(date_notification) = {k}) as m{k:02d}" for k in range(1, 13)) + f" {_NOW} and {_D} group by 1",
    "offre_unique_par_cpv": f"select famille, count(*) as marches, {O.half('100.0 * count(*) filter (where offres_recues = 1) / count(*)', 2)} as part_offre_unique from (select {_FAM} as famille, offres_recues {_NOW} and offres_recues is not null) where famille is not null group by 1 having count(*) > 30",
    "completude_champs": " union all ".join(f"select '{c}' as champ, count({c}) as remplis, count(*) as total, {O.half(f'100.0 * count({c}) / count(*)', 2)} as part {_NOW}" for c in COMPLETE),
    "acheteurs_quartiles": "select acheteur_categorie, count(*) as marches, " + ", ".join(f"{O.half(f'quantile_cont(montant, {p})', 2)} as {n}" for p, n in ((0.05, "p05"), (0.25, "q1"), (0.5, "mediane"), (0.75, "q3"), (0.95, "p95"))) + f" {_NOW} and montant > 0 and acheteur_categorie is not null group by 1 having count(*) > 30",
    "geographie_acheteurs": f"select round(distance_km / 100.0, 0) as x, round(duree_mois / 10.0, 0) as y, count(*) as marches {_NOW} and distance_km between 0 and 1000 and duree_mois between 1 and 60 group by 1, 2 having count(*) > 20",
    "evolution_mensuelle": f"select cast(date_trunc('month', date_notification) as date) as mois, count(*) as marches {_NOW} and {_D} group by 1",
    "distance_titulaires": f"select tranche, marches, {O.half('100.0 * marches / sum(marches) over ()', 2)} as part from (select {_band('distance_km', KM_CUTS, KM_LABELS)} as tranche, count(*) as marches {_NOW} and distance_km is not null group by 1)",
    "offre_unique_par_tranche": f"select {_band('montant', AMOUNT_CUTS, AMOUNT_LABELS)} as tranche, count(*) as marches, {O.half('100.0 * count(*) filter (where offres_recues = 1) / count(*)', 2)} as part_offre_unique, {O.half('median(montant)', 2)} as mediane {_NOW} and montant > 0 and offres_recues > 0 group by 1",
    "qualite_volume": "select count(*) as lignes, count(distinct uid) as uid, count(distinct acheteur_siret) as acheteurs, count(distinct titulaire_siret) as titulaires, min(annee) as premiere_annee, max(annee) as derniere_annee from marches",
    "qualite_lignes_par_uid": "select count(*) as contrats, count(*) filter (where n = 1) as une_ligne, count(*) filter (where n > 1) as plusieurs, max(n) as maximum from (select marche_id, count(*) as n from marches where marche_id is not null group by 1)",
    "qualite_origine_multiples": "select count(*) as groupes, count(*) filter (where t = n) as par_titulaire, count(*) filter (where t = 1) as meme_titulaire, count(*) filter (where t > 1 and t < n) as melange from (select marche_id, modification_id, count(*) as n, count(distinct titulaire_nom) as t from marches where marche_id is not null group by 1, 2) where n > 1",
    "qualite_lignes_actuelles": "select count(*) filter (where donneesActuelles) as actuelles, count(distinct case when donneesActuelles then marche_id end) as contrats, count(*) filter (where not donneesActuelles) as anciennes from marches",
    "qualite_montants": f"select count(*) filter (where montant is null) as absents, count(*) filter (where montant <= 0) as negatifs_ou_nuls, count(*) filter (where montant > 1e9) as geants, min(montant) as minimum, {O.half('median(montant)', 2)} as mediane, max(montant) as maximum from marches",
    "qualite_anomalies": "select coalesce(montant_anomalie, '(aucune)') as anomalie, count(*) as lignes from marches group by 1",
    "qualite_dates": "select count(*) filter (where date_notification is null) as absentes, cast(min(date_notification) as varchar) as premiere, cast(max(date_notification) as varchar) as derniere, count(*) filter (where date_notification < date '2015-01-01') as avant, count(*) filter (where date_notification > date '2025-12-31') as apres from marches",
    "qualite_offres": "select count(*) filter (where offres_recues is null) as absentes, count(*) filter (where offres_recues = 0) as nulles, count(*) filter (where offres_recues = 1) as uniques, count(*) filter (where offres_recues > 500) as invraisemblables, max(offres_recues) as maximum from marches",
    "qualite_durees": "select count(*) filter (where duree_mois is null) as absentes, cast(median(duree_mois) as double) as mediane, count(*) filter (where duree_mois > 120) as longues, max(duree_mois) as maximum from marches",
    "ids_contradictoires": f"select count(*) as repetes, count(*) filter (where montants > 1) as contradictoires from (select marche_id, titulaire_nom, count(*) as n, count(distinct montant) as montants {_NOW} and marche_id is not null group by 1, 2) where n > 1",
    "dispersion_familles": f"select famille_cpv, count(*) as n, {O.half('avg(l)', 4)} as moyenne, {O.half('stddev_samp(l)', 4)} as ecart_type, {O.half('quantile_cont(l, 0.01)', 4)} as p01, {O.half('quantile_cont(l, 0.99)', 4)} as p99 from (select famille_cpv, round(log10(montant), 4) as l {_NOW} and montant > 0 and famille_cpv is not null) group by 1",
    "correlations": "with x as (select round(log10(montant), 4) as l, duree_mois, offres_recues, distance_km, mois " + _NOW + " and montant > 0 and duree_mois > 0 and offres_recues > 0 and distance_km is not null and mois is not null) " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from x" for i, a in enumerate(["l", "duree_mois", "offres_recues", "distance_km", "mois"]) for b in ["l", "duree_mois", "offres_recues", "distance_km", "mois"][i + 1 :]),
    "occurrences_lexemes": f"select lexeme, count(*) as marches from (select unnest(list_distinct(string_split({O.FOLD.format('objet')}, ' '))) as lexeme {_NOW}) where lexeme <> '' group by 1",
}
ORACLES = O.typed(ORACLES)
QUERIES = {n: globals()[n] for n in ORACLES}
