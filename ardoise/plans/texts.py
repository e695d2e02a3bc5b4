"""Queries of lexemes, pieces of words, frequencies by threshold, catalogues and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ardoise.functions.columns import half_up
from ardoise.functions.text import fold, trigrams
from ardoise.operators import search as S
from ardoise.operators.layers import current
from ardoise.operators.linking import jaccard
from ardoise.plans import oracle as O
from ardoise.plans.search import _WORDS as _DOC
from ardoise.session import table
from ardoise.sources import collect


# Rows of one contract that its page shows.
SHOWN_ROWS = 200


def _docs(spark, d):
    return current(table(spark, d, "marches")).withColumn("mots", S.tokens(F.col("objet")))


def noms_trigrammes(spark, d):
    """FTS-10: notices and contracts of one family whose buyers' names share most three-letter pieces, by town."""
    a = table(spark, d, "avis").filter("ville is not null and acheteur_nom is not null").select("idweb", "ville", trigrams(fold(F.col("acheteur_nom"))).alias("t"))
    b = table(spark, d, "marches").filter("acheteur_commune_nom is not null and acheteur_nom is not null").select(F.col("acheteur_commune_nom").alias("ville"), "acheteur_nom").distinct().select("ville", "acheteur_nom", trigrams(fold(F.col("acheteur_nom"))).alias("u"))
    x = a.dropDuplicates(["idweb"]).join(b, "ville").withColumn("s", jaccard(F.col("t"), F.col("u"))).filter("s > 0.5")
    return x.groupBy("idweb").agg(F.count(F.lit(1)).alias("noms"), F.round(F.max("s"), 6).alias("meilleur"))


def effet_mots_vides(spark, d):
    """FTS-8, STR-7: matches of a question word by word, raw and cleaned of stop words."""
    raw = F.filter(F.split(F.coalesce(fold(F.col("objet")), F.lit("")), " "), lambda w: w != "")
    asked = ["marches", "pour", "la", "maintenance", "d", "une", "ecole"]
    x = current(table(spark, d, "marches")).select(raw.alias("bruts"))
    return x.agg(F.count_if(S.match_all(F.col("bruts"), asked)).alias("brute"), F.count_if(S.match_all(F.col("bruts"), ["maintenance", "ecole"])).alias("nettoyee"))


def seuils_frequence(spark, d):
    """STT-16: how many words each pair of least and largest frequency keeps, as a table of fixed columns."""
    docs = _docs(spark, d)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    f = docs.select(F.explode(F.array_distinct("mots")).alias("mot")).groupBy("mot").agg(F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(n)).select((F.col("k") / F.col("n")).alias("f"))
    low, high = [0.0005, 0.001, 0.005], [0.05, 0.12, 0.5]
    one = f.agg(*[F.count_if((F.col("f") >= a) & (F.col("f") <= b)).alias(f"c{i}{j}") for i, a in enumerate(low) for j, b in enumerate(high)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("au_moins"), *[F.col(f"c{i}{j}").alias(f"jusqu_{int(b * 100)}") for j, b in enumerate(high)]) for i, a in enumerate(low)])))


def catalogue(spark, d):
    """SRC-9, SRC-16: the address of the resource with each title, as a catalogue resolves it (an absent title is an error)."""
    pages = table(spark, d, "documents").filter("titre is not null and url is not null")
    titles = pages.groupBy("titre").agg(F.min("url").alias("url"), F.count(F.lit(1)).alias("ressources"))
    one = titles.orderBy("titre").first()
    if one is not None and collect.resource(pages, one.titre) != one.url:
        raise AssertionError("the catalogue resolves a title in two ways")
    return titles


def fiche_entreprise(spark, d):
    """SRC-10: each supplier number with the first category and name known for it."""
    x = table(spark, d, "marches").filter("titulaire_siret is not null")
    first = x.groupBy("titulaire_siret").agg(F.min_by(F.struct("titulaire_nom", "titulaire_categorie"), "id").alias("r"))
    return first.select("titulaire_siret", "r.titulaire_nom", "r.titulaire_categorie")


def compte_metadonnees(spark, d):
    """SRC-17: a bare count, which the scan answers without decoding a column."""
    return table(spark, d, "marches").agg(F.count(F.lit(1)).alias("lignes"))


def fiche_contrat(spark, d):
    """SRT-9: the rows of one contract by supplier; the list is bounded because it is shown."""
    m = table(spark, d, "marches").filter("marche_id is not null")
    # The contract with most rows, the smaller number first.
    most = m.groupBy("marche_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "marche_id").limit(1).select("marche_id")
    return m.join(F.broadcast(most), "marche_id", "left_semi").orderBy("titulaire_nom", "id").limit(SHOWN_ROWS).select("id", "titulaire_nom", "montant")


def part_du_total(spark, d):
    """WIN-9, SRT-12: share of each source in the total of groups, largest first."""
    x = current(table(spark, d, "marches")).groupBy("source").agg(F.count(F.lit(1)).alias("marches"))
    return x.withColumn("part", half_up(F.lit(100.0) * F.col("marches") / F.sum("marches").over(Window.partitionBy()), 4))


def jointures_absentes(spark, d):
    """JOI-16, SET-5: contracts without notice of their buyer (anti), and common towns (intersect)."""
    a, m = table(spark, d, "avis"), table(spark, d, "marches")
    anti = m.join(a.select("acheteur_nom").filter("acheteur_nom is not null"), "acheteur_nom", "left_anti").agg(F.count(F.lit(1)).alias("sans_avis"))
    towns = a.select(F.col("ville").alias("v")).filter("v is not null").intersect(m.select(F.col("acheteur_commune_nom").alias("v")).filter("v is not null")).agg(F.count(F.lit(1)).alias("villes"))
    return anti.crossJoin(F.broadcast(towns))


def ensembles_de_groupes(spark, d):
    """AGG-35: counts by category, by nature and in all, in one pass (grouping sets)."""
    x = current(table(spark, d, "marches"))
    return x.cube("acheteur_categorie", "annee").agg(F.count(F.lit(1)).alias("marches"), F.grouping_id().cast("long").alias("niveau"))


_RAW = f"list_filter(string_split(coalesce({O.FOLD.format('objet')}, ''), ' '), lambda w: w <> '')"
_TRI = "list_distinct(flatten(list_transform(list_filter(string_split(coalesce({0}, ''), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
ORACLES = O.typed({
    "noms_trigrammes": f"with a as (select idweb, ville, {_TRI.format(O.FOLD.format('acheteur_nom'))} as t from (select *, row_number() over (partition by idweb order by 1) as k from avis where ville is not null and acheteur_nom is not null) where k = 1), b as (select ville, {_TRI.format(O.FOLD.format('acheteur_nom'))} as u from (select distinct acheteur_commune_nom as ville, acheteur_nom from marches where acheteur_commune_nom is not null and acheteur_nom is not null)), x as (select idweb, len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u))) as s from a join b using (ville)) select idweb, count(*) as noms, round(max(s), 6) as meilleur from x where s > 0.5 group by 1",
    "effet_mots_vides": f"with x as (select {_RAW} as w from marches where donneesActuelles) select count(*) filter (where list_has_all(w, ['marches', 'pour', 'la', 'maintenance', 'd', 'une', 'ecole'])) as brute, count(*) filter (where list_has_all(w, ['maintenance', 'ecole'])) as nettoyee from x",
    "seuils_frequence": f"with {_DOC}, f as (select count(*) / (select count(*) from docs) as f from (select unnest(list_distinct(mots)) as mot from docs) group by mot) select cast(a as double) as au_moins, count(*) filter (where f >= a and f <= 0.05) as jusqu_5, count(*) filter (where f >= a and f <= 0.12) as jusqu_12, count(*) filter (where f >= a and f <= 0.5) as jusqu_50 from f, (values (0.0005), (0.001), (0.005)) v(a) group by 1",
    "catalogue": "select titre, min(url) as url, count(*) as ressources from documents where titre is not null and url is not null group by 1",
    "fiche_entreprise": "select titulaire_siret, titulaire_nom, titulaire_categorie from (select *, row_number() over (partition by titulaire_siret order by id) as k from marches where titulaire_siret is not null) where k = 1",
    "compte_metadonnees": "select count(*) as lignes from marches",
    "fiche_contrat": "select id, titulaire_nom, montant from marches where marche_id = (select marche_id from marches where marche_id is not null group by 1 order by count(*) desc, marche_id limit 1) order by titulaire_nom, id limit 200",
    "part_du_total": f"select source, marches, {O.half('100.0 * marches / sum(marches) over ()', 4)} as part from (select source, count(*) as marches from marches where donneesActuelles group by 1)",
    "jointures_absentes": "select (select count(*) from marches m where not exists (select 1 from avis a where a.acheteur_nom = m.acheteur_nom)) as sans_avis, (select count(*) from (select ville from avis where ville is not null intersect select acheteur_commune_nom from marches where acheteur_commune_nom is not null)) as villes",
    "ensembles_de_groupes": "select acheteur_categorie, annee, count(*) as marches, cast(grouping(acheteur_categorie, annee) as bigint) as niveau from marches where donneesActuelles group by cube (acheteur_categorie, annee)",
})
QUERIES = {n: globals()[n] for n in ORACLES}
