"""Queries of linking by level, judged verdicts, sources, sinks and streams."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from ardoise.functions.columns import half_up
from ardoise.operators import linking as L
from ardoise.operators import search as S
from ardoise.operators.layers import current
from ardoise.plans import oracle as O
from ardoise.plans.search import _WORDS as _WORDS_OF_SUBJECTS
from ardoise.session import keep, shared_folder, table
from ardoise.sources import collect, publish
from ardoise.streaming import events as E


def _n(spark, d):
    return table(spark, d, "avis")


def _m(spark, d):
    return table(spark, d, "marches")


def liens_candidats(spark, d):
    """JOI-11, LNK-2, DAT-4: equal buyer, band of dates."""
    return L.candidates(_n(spark, d).filter("idweb is not null").dropDuplicates(["idweb"]), _m(spark, d))


def liens_niveaux(spark, d):
    """LNK-1."""
    return L.levels(_n(spark, d), _m(spark, d))


def liens_entonnoir(spark, d):
    """LNK-3."""
    return L.funnel(L.levels(_n(spark, d), _m(spark, d)))


def liens_balayage(spark, d):
    """LNK-4."""
    return L.sweep(_n(spark, d), _m(spark, d), [180, 360, 540, 720, 1080], [0.2, 0.3, 0.4, 0.5, 0.6, 0.7])


def liens_echantillon(spark, d):
    """LNK-5."""
    return L.stratified(L.levels(_n(spark, d), _m(spark, d)))


def liens_nombre_candidats(spark, d):
    """LNK-6: upper median and maximum of the candidates."""
    x = L.levels(_n(spark, d), _m(spark, d)).filter("candidats > 0")
    # The window runs over one row for each number of candidates.
    per = x.groupBy("candidats").agg(F.count(F.lit(1)).alias("k"))
    w = per.select("candidats", F.sum("k").over(L.Window.orderBy("candidats")).alias("jusqu"), F.sum("k").over(L.Window.partitionBy()).alias("n"))
    return w.agg(F.min(F.when(F.col("jusqu") >= F.floor(F.col("n") / 2) + 1, F.col("candidats"))).alias("mediane_haute"), F.max("candidats").alias("maximum"))


def liens_difflib(spark, d):
    """STR-10: of every notice the candidate of the band join whose subject is most similar; equal ones by the smaller id."""
    n = _n(spark, d).filter("idweb is not null").dropDuplicates(["idweb"])
    return L.most_similar(n, _m(spark, d))


def verdicts_tableau(spark, d):
    """LNK-7, STT-17."""
    return L.verdict_table(table(spark, d, "verdicts_rapprochement"))


def verdicts_decision(spark, d):
    """LNK-8."""
    return L.decision_table(table(spark, d, "verdicts_rapprochement"))


def verdicts_titulaire(spark, d):
    """STT-19: share judged right where the supplier agrees."""
    v = table(spark, d, "verdicts_rapprochement").filter("titulaire_concorde = 'oui' and verdict_humain in ('oui', 'non')")
    return v.agg(F.count(F.lit(1)).alias("n"), half_up(F.try_divide(F.lit(100.0) * F.count_if(F.col("verdict_humain") == "oui"), F.count(F.lit(1)).cast("double")), 4).alias("part"))


def avis_par_annee(spark, d):
    """SRC-8: grouped counts of notices with their first and last day, still open on a fixed day or not."""
    return _n(spark, d).groupBy(F.year("date_parution").alias("annee")).agg(F.count(F.lit(1)).alias("avis"), F.min("date_parution").alias("premier"), F.max("date_parution").alias("dernier"), F.count_if(F.col("date_parution") > F.lit("2020-06-30").cast("date")).alias("ouverts"))


def sonde_cle_exacte(spark, d):
    """JOI-12, FIL-11: exact key probe of two sources, and how many rows hold the key inside another number."""
    s = table(spark, d, "signaux").select("marche_id").distinct()
    m = _m(spark, d).select("id", "uid")
    exact = m.join(s, m.uid == s.marche_id).agg(F.count(F.lit(1)).alias("exactes"))
    inside = m.filter(F.contains("uid", F.lit("/"))).select(F.substring_index("uid", "/", -1).alias("marche_id")).join(s, "marche_id").agg(F.count(F.lit(1)).alias("contenues"))
    return exact.crossJoin(F.broadcast(inside))


def manifeste(spark, d):
    """SNK-7: one entry per day and source of publication; what the later lots delivered replaces what the earlier ones did."""
    entry = _m(spark, d).groupBy(F.date_format("date_publication", "yyyy-MM-dd").alias("jour"), "source", (F.col("lot") >= 10).alias("tard")).agg(F.min("lot").alias("premier_lot"), F.count(F.lit(1)).alias("lignes"))
    old, new = (entry.filter(c).drop("tard").filter("jour is not null and source is not null") for c in ("not tard", "tard"))
    return collect.upsert_manifest(old, new)


def api_paginee(spark, d):
    """SRC-7, SRC-6: notices fetched page by page in lanes until an empty page; the dates are filtered by the service.

    The table of notices stands for the service: each page is a slice of it, cut where the page is asked for.
    """
    path, first, end = f"{d}/avis.parquet", datetime.date(2019, 1, 1), datetime.date(2021, 1, 1)

    def fetch(offset: int, size: int) -> list[dict]:
        import pyarrow.dataset as ds

        when = ds.field("date_parution")
        held = ds.dataset(path).to_table(columns=["idweb", "date_parution", "montant_estime"], filter=(when >= first) & (when < end), use_threads=False)
        return held.slice(offset, size).to_pylist()

    spark.dataSource.register(collect.paged_source("ardoise_avis", fetch))
    doc = spark.read.format("ardoise_avis").load()
    return doc.select(F.get_json_object("document", "$.idweb").alias("idweb"), F.get_json_object("document", "$.date_parution").cast("date").alias("date_parution"), F.get_json_object("document", "$.montant_estime").cast("double").alias("montant_estime"))


def aller_retour(spark, d):
    """SNK-1, SNK-4: a layer written and read again."""
    path = f"{shared_folder(spark)}/couche-{uuid.uuid4().hex}"
    publish.layer(_m(spark, d).select("id", "lot", "montant"), path, by=["lot"])
    return spark.read.parquet(path).groupBy("lot").agg(F.count(F.lit(1)).alias("n"), F.max("montant").alias("m"))


def statistiques_remplacees(spark, d):
    """SNK-8: figures of the first lots, then those of all lots over them: years that are there are replaced, new ones added."""
    def figures(lots):
        return current(_m(spark, d)).filter(f"annee is not null and lot < {lots}").groupBy("annee").agg(F.count(F.lit(1)).alias("marches"), F.max("montant").alias("plus_grand"))

    path = f"{shared_folder(spark)}/statistiques-{uuid.uuid4().hex}"
    keep(spark, path)
    publish.replace_rows(spark, path, figures(5), ["annee"])
    publish.replace_rows(spark, path, figures(10_000), ["annee"])
    return spark.read.parquet(path)


def vocabulaire_recharge(spark, d):
    """SNK-9: a vocabulary emptied and filled again."""
    path = f"{shared_folder(spark)}/vocabulaire-{uuid.uuid4().hex}"
    keep(spark, path)
    x = current(_m(spark, d)).withColumn("mots", S.tokens(F.col("objet")))
    publish.reload(S.vocabulary(x.filter("lot < 5"), "mots"), path)
    publish.reload(S.vocabulary(x, "mots"), path)
    return spark.read.parquet(path)


def echantillon_blocs(spark, d):
    """SRC-13: a seeded sample."""
    return _m(spark, d).sample(0.05, 42).select("id")


def flux_fenetres(spark, d):
    """Streaming: tumbling windows over the events, complete."""
    x = E.complete(E.windows(E.read(spark, d), "1 day", "365 days"), "fenetres")
    return x.select(F.col("window.start").cast("string").alias("debut"), "event_type", "n")


def flux_sessions(spark, d):
    """Streaming: sessions of each user."""
    x = E.complete(E.sessions(E.read(spark, d), "30 minutes", "365 days"), "sessions")
    return x.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("evenements"))


_FB = O.FOLD
S_VOCABULARY = f"with {_WORDS_OF_SUBJECTS} select lexeme, count(*) as marches, (select count(*) from docs) as echantillon from (select unnest(list_distinct(mots)) as lexeme from docs) group by 1"
_WORDS = "list_distinct(list_filter(string_split(coalesce({0}, ''), ' '), lambda w: length(w) > 2))"
_C = (
    f"n0 as (select *, row_number() over (partition by idweb order by 1) as k from avis where idweb is not null), n as (select idweb, {_FB.format('acheteur_nom')} as a, date_parution as p, {_WORDS.format(_FB.format('objet_boamp'))} as mn, {_FB.format('titulaire_nom')} as tn from n0 where k = 1), "
    f"c as (select id, {_FB.format('acheteur_nom')} as b, date_notification as dd, {_WORDS.format(_FB.format('objet'))} as mc, {_FB.format('titulaire_nom')} as tc from marches where date_notification between date '2010-01-01' and date '2030-12-31'), "
    "cand as (select idweb, id, date_diff('day', p, dd) as jours, round(coalesce(len(list_intersect(mn, mc)) / nullif(len(list_distinct(list_concat(mn, mc))), 0), 0.0), 6) as similarite, coalesce(tn = tc, false) as titulaire from n join c on a = b and dd between p - 90 and p + 540), "
    f"lev as (select n.idweb, case when t then 4 when s > 0.6 then 3 when k > 0 then 2 when a in (select {_FB.format('acheteur_nom')} from marches where acheteur_nom is not null) then 1 else 0 end as niveau, s as similarite, coalesce(k, 0) as candidats from n left join (select idweb, max(similarite) as s, bool_or(titulaire) as t, count(*) as k from cand group by 1) x using (idweb))"
)
_V = "v as (select tranche, count(*) filter (where verdict_humain = 'oui') as oui, count(*) filter (where verdict_humain = 'non') as non, count(*) filter (where verdict_humain = 'doute') as doute from verdicts_rapprochement group by 1)"
ORACLES = {
    "liens_candidats": f"with {_C} select * from cand",
    "liens_niveaux": f"with {_C} select * from lev",
    "liens_entonnoir": f"with {_C} select r as niveau, count(*) filter (where lev.niveau >= r) as avis, {O.half('100.0 * count(*) filter (where lev.niveau >= r) / count(*)', 2)} as part from lev, range(0, 5) t(r) group by 1",
    "liens_balayage": f"with {_C.replace('p + 540', 'p + 1080')}, g as (select w, t from (values (180), (360), (540), (720), (1080)) a(w), (values (0.2), (0.3), (0.4), (0.5), (0.6), (0.7)) b(t)) select w as fenetre, t as seuil, (select count(*) from (select idweb from cand where jours <= w group by 1 having max(similarite) > t)) as lies from g",
    "liens_echantillon": f"with {_C} select bande, idweb, similarite from (select cast(floor(least(round(similarite * 10, 6), 9.0)) as int) as bande, idweb, similarite, row_number() over (partition by floor(least(round(similarite * 10, 6), 9.0)) order by idweb) as k from lev where similarite >= 0.4) where k <= 12",
    "liens_nombre_candidats": f"with {_C}, x as (select candidats, row_number() over (order by candidats) as k, count(*) over () as n from lev where candidats > 0) select max(case when k = n // 2 + 1 then candidats end) as mediane_haute, max(candidats) as maximum from x",
    "verdicts_tableau": f"with {_V} select tranche, oui, non, doute, {O.half('100.0 * oui / nullif(oui + non, 0)', 4)} as justesse from v",
    "verdicts_decision": f"with {_V}, w as (select cast(substr(tranche, 1, 3) as double) as borne, oui + non + doute as taille, coalesce({O.half('100.0 * oui / nullif(oui + non, 0)', 4)}, 0.0) as j from v) select borne, sum(taille) over (order by borne desc rows unbounded preceding) as paires, {O.half('sum(taille * j / 100) over (order by borne desc rows unbounded preceding)', 2)} as attendues_justes from w",
    "verdicts_titulaire": f"select count(*) as n, {O.half(chr(39).join(['100.0 * count(*) filter (where verdict_humain = ', 'oui', ') / count(*)']), 4)} as part from verdicts_rapprochement where titulaire_concorde = 'oui' and verdict_humain in ('oui', 'non')",
    "avis_par_annee": "select year(date_parution) as annee, count(*) as avis, min(date_parution) as premier, max(date_parution) as dernier, count(*) filter (where date_parution > date '2020-06-30') as ouverts from avis group by 1",
    "sonde_cle_exacte": "with s as (select distinct marche_id from signaux) select (select count(*) from marches m join s on m.uid = s.marche_id) as exactes, (select count(*) from marches m join s on split_part(m.uid, '/', -1) = s.marche_id where contains(m.uid, '/')) as contenues",
    "manifeste": "with e as (select strftime(date_publication, '%Y-%m-%d') as jour, source, lot >= 10 as tard, min(lot) as premier_lot, count(*) as lignes from marches where date_publication is not null and source is not null group by all) select jour, source, premier_lot, lignes from e a where tard or not exists (select 1 from e b where b.jour = a.jour and b.source = a.source and b.tard)",
    "api_paginee": "select idweb, date_parution, montant_estime from avis where date_parution >= date '2019-01-01' and date_parution < date '2021-01-01'",
    "statistiques_remplacees": "select annee, count(*) as marches, max(montant) as plus_grand from marches where donneesActuelles and annee is not null group by 1",
    "vocabulaire_recharge": S_VOCABULARY,
    "aller_retour": "select lot, count(*) as n, max(montant) as m from marches group by 1",
    "flux_fenetres": "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as debut, event_type, count(*) as n from events group by 1, 2",
    "flux_sessions": "with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as s from events) select user_id, sum(s) as sessions, count(*) as evenements from x group by 1",
}
ORACLES = O.typed(ORACLES)
QUERIES = {n: globals()[n] for n in [*ORACLES, "liens_difflib", "echantillon_blocs"]}
