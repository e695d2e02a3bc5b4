"""Queries of search, ranking, pages, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ardoise.functions.columns import french_decimal, french_euros, half_up, ratio_phrase
from ardoise.functions.text import excerpt, fold, one_line
from ardoise.operators import index as X
from ardoise.operators import search as S
from ardoise.operators.layers import current
from ardoise.operators.prefix import ranked
from ardoise.plans import oracle as O
from ardoise.session import table

TERMS = ["maintenance", "ecole"]


def _m(spark, d):
    return table(spark, d, "marches")


def _docs(spark, d):
    return current(_m(spark, d)).withColumn("mots", S.tokens(F.col("objet")))


def _now(spark, d):
    return current(_m(spark, d))


def _ix(spark, d):
    """FTS-1, FTS-2: subjects weigh A, names of buyer and supplier B."""
    return X.index(_now(spark, d), [("objet", "A"), ("acheteur_nom", "B"), ("titulaire_nom", "B")], "marches")


def index_recherche(spark, d):
    """FTS-1, FTS-2: the stored index of stems, built or found: documents and words by weight."""
    return _ix(spark, d).totals.select("poids", "documents", "mots")


def recherche_et(spark, d):
    """FTS-3."""
    return X.rows_of(_now(spark, d).select("id", "objet"), X.having_all(_ix(spark, d), TERMS, "A"))


def recherche_ou(spark, d):
    """FTS-4."""
    return X.having_any(_ix(spark, d), TERMS, "A")


def recherche_web(spark, d):
    """FTS-3: alternatives, exclusion and a phrase."""
    return X.web(_ix(spark, d), S.parse('ascenseurs or toiture -ecole "prestation maintenance"'), "A")


def recherche_cascade(spark, d):
    """FTS-5: nothing has all three words, so any of them counts."""
    return X.cascade(_ix(spark, d), ["ascenseurs", "toiture", "introuvable"], "A")


def recherche_bm25(spark, d):
    """FTS-7."""
    return X.bm25(_ix(spark, d), TERMS).select("id", F.round("score", 6).alias("score"))


def recherche_densite(spark, d):
    """FTS-2, FTS-6: cover density over the weighted document."""
    return X.densities(_ix(spark, d), TERMS)


def recherche_densite_un_mot(spark, d):
    """FTS-6: of a single word, every occurrence adds the weight of its field."""
    return X.densities(_ix(spark, d), ["toitures"]).select("id", F.round("score", 6).alias("score"))


def recherche_page(spark, d):
    """SRT-1, SRT-3: the second page by amount, and one row more."""
    x = X.rows_of(_now(spark, d).select("id", "montant"), X.having_all(_ix(spark, d), ["maintenance"], "A"))
    return S.page(x.orderBy(F.desc_nulls_last("montant"), "id"), 2, 10)


def preuve_accents(spark, d):
    """FTS-1, FTS-11: whatever the spelling asked for, with accents, capitals or in the plural, the same lexeme and documents."""
    f = X.frequencies(_ix(spark, d))
    asked = [(w, X.lexemes(S.query_terms(w))[0]) for w in ("école", "Écoles", "ECOLE", "maintenance", "Maintenances", "toiture", "ascenseurs")]
    x = spark.createDataFrame(asked, "demande string, lexeme string")
    return f.join(F.broadcast(x), "lexeme").select("demande", "lexeme", "marches", "echantillon")


def vocabulaire_lexemes(spark, d):
    """FTS-9, SNK-9: frequency of every lexeme with the number of documents."""
    return X.frequencies(_ix(spark, d))


def liste_recente(spark, d):
    """SRT-2, PRJ-15: most recent first, missing dates first as in the serving database."""
    x = current(_m(spark, d)).filter(S.filters(year=2019, low=1000)).select("id", "date_notification", F.lit(None).cast("long").alias("candidats"), F.lit(0.0).alias("score"))
    return x.orderBy(F.desc_nulls_first("date_notification"), F.desc("id")).limit(20)


def filtres_api(spark, d):
    """FIL-4, FIL-5."""
    return current(_m(spark, d)).filter(S.filters(year=2020, low=10_000, high=500_000, single_bid=True)).select("id", "montant")


def classement_borne(spark, d):
    """SRT-4, WIN-4: bounded ranking that says so."""
    return X.bounded_ranking(_ix(spark, d), _now(spark, d), ["maintenance"]).select("rang", "id", F.round("score", 6).alias("score"), "candidats_examines", "classement_approche")


def vocabulaire(spark, d):
    """FTS-9, SNK-9, JOI-13: frequency of each word with the size of the sample."""
    return S.vocabulary(_docs(spark, d), "mots")


def citations(spark, d):
    """AGG-27, ARR-3, SRT-5: the three largest contracts of each buyer."""
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("montant")).alias("k"), F.col("id")))), 1, 3)
    # Ranking first keeps at most three rows a buyer before anything is collected.
    w = Window.partitionBy("acheteur_siret").orderBy(F.desc("montant"), "id")
    x = current(_m(spark, d)).filter("montant is not null and acheteur_siret is not null").withColumn("_k", F.row_number().over(w)).filter("_k <= 3")
    return x.groupBy("acheteur_siret").agg(F.transform(top, lambda s: s["id"]).alias("ids"))


def premiers_titulaires(spark, d):
    """SRT-6."""
    x = current(_m(spark, d)).filter("titulaire_nom is not null").groupBy("titulaire_nom").agg(F.count(F.lit(1)).alias("marches"), half_up(F.sum("montant"), 2).alias("total"))
    return x.orderBy(F.desc("marches"), F.desc_nulls_last("total"), "titulaire_nom").limit(10)


def extraits_montant(spark, d):
    """SRT-7, SRT-14."""
    return current(_m(spark, d)).filter("montant < 1e9").orderBy(F.desc("montant"), "id").select("id", "montant", F.coalesce("acheteur_region_nom", F.lit("(inconnue)")).alias("region")).limit(10)


def signaux_page(spark, d):
    """SRT-8, JOI-7: strongest first, with one row of the contract (the smallest id) beside each."""
    s = table(spark, d, "signaux").filter("signaux_forts >= 1").orderBy(F.desc("signaux_forts"), F.desc_nulls_last("ecart_normalise_famille"), "id").limit(20)
    w = Window.partitionBy("marche_id").orderBy("id")
    one = _m(spark, d).withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("marche_id", F.col("id").alias("ligne"), "objet")
    return s.join(one, "marche_id", "left").select("id", "marche_id", "signaux_forts", "ligne", "objet")


def signaux_un_par_contrat(spark, d):
    """WIN-7, JOI-9: one row of each contract, the strongest; the list is then in the order of numbers."""
    w = Window.partitionBy("marche_id").orderBy(F.desc("signaux_forts"), F.desc_nulls_last("ecart_normalise_famille"), "id")
    return table(spark, d, "signaux").withColumn("_k", F.row_number().over(w)).filter("_k = 1").orderBy("marche_id").select("marche_id", "id", "signaux_forts").limit(10)


def signaux_par_famille(spark, d):
    """JOI-5, JOI-6: the many-to-many join of the served statistics, and its count by row beside it."""
    m = _m(spark, d).filter("marche_id is not null and famille_cpv is not null")
    s = table(spark, d, "signaux").filter("signaux_forts > 0")
    fan = m.join(s.select("marche_id"), "marche_id").groupBy("famille_cpv").agg(F.count(F.lit(1)).alias("signales_joints"))
    rows = m.join(s.select("marche_id").distinct(), "marche_id", "left_semi").groupBy("famille_cpv").agg(F.count(F.lit(1)).alias("signales_lignes"))
    base = m.groupBy("famille_cpv").agg(F.count(F.lit(1)).alias("marches"))
    return base.join(fan, "famille_cpv", "left").join(rows, "famille_cpv", "left").na.fill(0)


def valeurs_distinctes(spark, d):
    """SET-2, SET-4: what the loose index scan computes."""
    return _m(spark, d).select("acheteur_departement_code").filter("acheteur_departement_code is not null").distinct().orderBy("acheteur_departement_code")


def ids_dans_texte(spark, d):
    """STR-5, SET-3, ARR-2, ARR-4, ARR-5: numbers of 6 or 14 figures found in page addresses and texts, repeats dropped, exploded."""
    x = table(spark, d, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all(F.concat_ws("\n", "url", "text"), F.lit(r"\b(\d{6}|\d{14})\b"), 1)).alias("ids"))
    y = x.withColumn("reste", F.array_remove("ids", F.lit("000000"))).withColumn("contient", F.array_contains("ids", F.lit("123456")))
    return y.select("doc_id", "contient", F.explode("reste").alias("numero"))


def semi_jointure(spark, d):
    """FIL-9, JOI-10: rows whose buyer is in a parameter list."""
    wanted = spark.createDataFrame([(["99000103000019", "99000000200019", "99000104000018"],)], "ids array<string>").select(F.explode("ids").alias("acheteur_siret"))
    return _m(spark, d).join(F.broadcast(wanted), "acheteur_siret", "left_semi").select("id", "acheteur_siret")


def identifiants_longs(spark, d):
    """FIL-10, STR-1: identifiers that have not the usual length, and the substring predicate."""
    return _m(spark, d).filter((F.length("titulaire_siret") != 14) | F.contains(F.col("uid"), F.lit("/"))).select("id", F.substring("titulaire_siret", 1, 9).alias("siren"))


def textes_courts(spark, d):
    """STR-6, STR-8, STR-9: folded, on one line, cut at a word."""
    return _m(spark, d).select("id", fold(F.col("objet")).alias("plie"), excerpt(one_line(F.col("objet")), 40).alias("extrait"))


def nombres_francais(spark, d):
    """STR-13..15, CST-1: amounts read from and written as French text."""
    x = current(_m(spark, d)).filter("montant is not null and abs(montant) < 1e12")
    typed = F.concat(F.floor(F.abs("montant") / 1000).cast("string"), F.lit(" "), F.lpad((F.floor(F.abs("montant")) % 1000).cast("string"), 3, "0"), F.lit(",5"))
    return x.select("id", french_decimal(typed).alias("lu"), french_euros(F.col("montant")).alias("ecrit"))


def phrase_mediane(spark, d):
    """MTH-5, STR-16: each family's median against that of all, and its label with a fallback."""
    labels = spark.createDataFrame([("33", "Matériels médicaux"), ("45", "Travaux"), ("79", "Services aux entreprises")], "famille_cpv string, libelle string")
    x = current(_m(spark, d)).filter("montant > 0").groupBy("famille_cpv").agg(F.median("montant").alias("m"))
    whole = current(_m(spark, d)).filter("montant > 0").agg(F.median("montant").alias("t"))
    label = F.coalesce("libelle", F.concat(F.lit("Division "), "famille_cpv"), F.lit("Famille non precisee"))
    return x.crossJoin(F.broadcast(whole)).join(F.broadcast(labels), "famille_cpv", "left").select("famille_cpv", label.alias("libelle"), F.regexp_replace(ratio_phrase(F.col("m"), F.col("t")), r"^[0-9.,]+ ", "").alias("phrase"))


def regle_logarithmique(spark, d):
    """MTH-1, MTH-4, MTH-6: place of each family's median on a log ruler, and the width of its bar."""
    x = current(_m(spark, d)).filter("montant > 0 and famille_cpv is not null").groupBy("famille_cpv").agg(F.count(F.lit(1)).alias("n"), F.round(F.log10(F.median("montant")), 6).alias("l"))
    w = Window.partitionBy()
    lo, hi = F.min("l").over(w), F.max("l").over(w)
    margin = F.greatest(F.lit(0.25), 0.12 * (hi - lo))
    return x.select("famille_cpv", F.round(640 * (F.col("l") - (lo - margin)) / ((hi + margin) - (lo - margin))).cast("long").alias("place"), F.greatest(F.lit(1.0), F.round(180.0 * F.col("n") / F.max("n").over(w))).cast("long").alias("barre"))


def json_evenements(spark, d):
    """STR-11, STR-12: layout of a JSON text by its first key, and a path in it."""
    x = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return x.groupBy(F.when(F.contains("props", F.lit('"k"')), "k").otherwise("autre").alias("forme")).agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("somme"))


def empreintes(spark, d):
    """SNK-10: SHA-256 of every page."""
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("empreinte"))


def numeros_de_ligne(spark, d):
    """WIN-5, SRT-11: surrogate row number over a total order."""
    x = table(spark, d, "verdicts_rapprochement").groupBy("idweb", "objet_decp").agg(F.count(F.lit(1)).alias("n"))
    return ranked(x.select("idweb", "objet_decp"), [F.col("idweb"), F.col("objet_decp")]).withColumnRenamed("rang", "ligne")


def somme_des_montants(spark, d):
    """AGG-5, the amount of a contract with several suppliers: the value if every row has it, else unknown."""
    x = current(_m(spark, d)).filter("marche_id is not null").groupBy("marche_id").agg(F.count_distinct("montant").alias("k"), F.count(F.lit(1)).alias("lignes"), F.count("montant").alias("avec"), F.max("montant").alias("m"))
    return x.select("marche_id", "lignes", F.when((F.col("k") == 1) & (F.col("avec") == F.col("lignes")), F.col("m")).alias("montant"))


def ratios_accueil(spark, d):
    """Home page figures: over-count of amounts and share of unresolved suppliers."""
    x = current(_m(spark, d)).filter("marche_id is not null and montant between 0 and 1e9")
    cents = F.round(F.col("montant") * 100).cast("long")
    gross = x.agg(F.sum(cents).alias("brut"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("titulaire_siret").isNull()).alias("inconnus"))
    net = x.select("marche_id", cents.alias("c")).distinct().agg(F.sum("c").alias("net"))
    return gross.crossJoin(F.broadcast(net)).select(half_up(F.lit(100.0) * (F.col("brut") - F.col("net")) / F.col("net"), 4).alias("surcompte"), half_up(F.lit(100.0) * F.col("inconnus") / F.col("n"), 4).alias("inconnus"))


def delais(spark, d):
    """DAT-3..6, MTH-8: days between two dates, kept within bounds, with centiles."""
    days = F.datediff(F.col("date_publication"), F.col("date_notification"))
    x = _m(spark, d).withColumn("jours", days).filter("jours between 0 and 120").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.median("jours").cast("double").alias("mediane"), half_up(F.percentile("jours", 0.95), 4).alias("p95"))
    return x


_NOW = "marches where donneesActuelles"
_STOP = "[" + ", ".join(f"'{w}'" for w in S.STOP) + "]"
_TOK = f"list_filter(string_split(coalesce({O.FOLD.format('objet')}, ''), ' '), lambda w: w <> '' and not list_contains({_STOP}, w))"
# Words of one lexeme, of those that the queries ask for, cut ones included.
_FAMILIES = {"mainten": "^mainten(|e|a|ances?|ants?|antes?|ir|ait|aient|i)$", "ecol": "^ecol(|e|es)$", "ascenseur": "^ascenseurs?$", "toitur": "^toitur(|e|es)$", "prestat": "^prestat(|i|ions?)$", "introuv": "^introuv(|ables?)$"}
_STEM = "case " + " ".join(f"when regexp_matches(w, '{p}') then '{s}'" for s, p in _FAMILIES.items()) + " else '=' || w end"
_TOK_OF = lambda c: f"list_transform(list_filter(string_split(coalesce({O.FOLD.format(c)}, ''), ' '), lambda w: w <> '' and not list_contains({_STOP}, w)), lambda w: {_STEM})"
_DOC = f"docs as (select *, {_TOK_OF('objet')} as mots, {_TOK_OF('acheteur_nom')} || {_TOK_OF('titulaire_nom')} as noms from {_NOW})"
_WORDS = f"docs as (select *, {_TOK} as mots from {_NOW})"
_ASKED = {"maintenance": "mainten", "ecole": "ecol", "ascenseurs": "ascenseur", "toiture": "toitur", "prestation": "prestat", "introuvable": "introuv"}


_THIN = " "
_SAID = "translate(replace(regexp_replace(format('{{:,.1f}}', v / {0}), '\\.0$', ''), ',', '" + _THIN + "'), '.', ',') || ' {1}' || case when round(v / {0}, 1) >= 2 then 's' else '' end"


def _all_terms(terms: list[str]) -> str:
    return " and ".join(f"list_contains(mots, '{_ASKED[t]}')" for t in terms)


def _bm(terms: list[str]) -> str:
    part, terms = [], [_ASKED[t] for t in terms]
    for t in terms:
        tf = f"len(list_filter(mots, lambda w: w = '{t}'))"
        part.append(f"ln((n - df_{t} + 0.5) / (df_{t} + 0.5) + 1.0) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * len(mots) / l))")
    return f"with {_DOC}, t as (select count(*) as n, avg(len(mots)) as l, " + ", ".join(f"count(*) filter (where list_contains(mots, '{t}')) as df_{t}" for t in terms) + f" from docs) select id, round({' + '.join(part)}, 6) as score from docs, t where {' or '.join(f'list_contains(mots, {chr(39)}{t}{chr(39)})' for t in terms)}"


ORACLES = {
    "recherche_et": f"with {_DOC} select id, objet from docs where {_all_terms(TERMS)}",
    "recherche_ou": f"with {_DOC} select id from docs where list_contains(mots, 'mainten') or list_contains(mots, 'ecol')",
    "recherche_web": f"with {_DOC} select id from docs where (list_contains(mots, 'ascenseur') or list_contains(mots, 'toitur')) and not list_contains(mots, 'ecol') and contains(' ' || array_to_string(mots, ' ') || ' ', ' prestat mainten ')",
    "recherche_cascade": f"with {_DOC}, b as (select id from docs where {_all_terms(['ascenseurs', 'toiture', 'introuvable'])}) select id, 'et' as mode from b union all select id, 'ou' from docs where (select count(*) from b) = 0 and (list_contains(mots, 'ascenseur') or list_contains(mots, 'toitur') or list_contains(mots, 'introuv'))",
    "recherche_bm25": _bm(TERMS),
    "recherche_page": f"with {_DOC} select id, montant from docs where list_contains(mots, 'mainten') order by montant desc nulls last, id limit 11 offset 10",
    "liste_recente": f"select id, date_notification, cast(null as bigint) as candidats, 0.0 as score from {_NOW} and annee = 2019 and montant >= 1000 order by date_notification desc nulls first, id desc limit 20",
    "filtres_api": f"select id, montant from {_NOW} and annee = 2020 and montant between 10000 and 500000 and offre_unique",
    "classement_borne": f"with {_DOC}, c as (select id, montant, mots, noms from docs where list_contains(mots, 'mainten') order by date_notification desc nulls last, id desc limit 5000), s as (select id, montant, round(len(list_filter(mots, lambda w: w = 'mainten')) + 0.4 * len(list_filter(noms, lambda w: w = 'mainten')), 6) as score from c) select row_number() over (order by score desc, montant desc nulls last, id) as rang, id, cast(score as double) as score, count(*) over () as candidats_examines, count(*) over () >= 5000 as classement_approche from s",
    "nombres_francais": f"with x as (select id, montant as v from {_NOW} and montant is not null and abs(montant) < 1e12) select id, floor(abs(v)) + 0.5 as lu, case when v >= 1e9 then {_SAID.format('1e9', 'milliard')} when v >= 1e6 then {_SAID.format('1e6', 'million')} else replace(format('{{:,.0f}}', v), ',', '{_THIN}') || ' euro' || case when round(v) >= 2 then 's' else '' end end as ecrit from x",
    "index_recherche": f"with {_DOC} select 'A' as poids, count(*) as documents, sum(len(mots)) as mots from docs union all select 'B', count(*), sum(len(noms)) from docs",
    "recherche_densite_un_mot": f"with {_DOC} select id, round(len(list_filter(mots, lambda w: w = 'toitur')) + 0.4 * len(list_filter(noms, lambda w: w = 'toitur')), 6) as score from docs where list_contains(mots, 'toitur') or list_contains(noms, 'toitur')",
    "preuve_accents": f"with {_DOC} select demande, lexeme, (select count(*) from docs where list_contains(mots, lexeme)) as marches, (select count(*) from docs) as echantillon from (values ('école', 'ecol'), ('Écoles', 'ecol'), ('ECOLE', 'ecol'), ('maintenance', 'mainten'), ('Maintenances', 'mainten'), ('toiture', 'toitur'), ('ascenseurs', 'ascenseur')) v(demande, lexeme)",
    "vocabulaire": f"with {_WORDS} select lexeme, count(*) as marches, (select count(*) from docs) as echantillon from (select unnest(list_distinct(mots)) as lexeme from docs) group by 1",
    "citations": f"select acheteur_siret, list(id order by montant desc, id) as ids from (select acheteur_siret, id, montant, row_number() over (partition by acheteur_siret order by montant desc, id) as k from {_NOW} and montant is not null and acheteur_siret is not null) where k <= 3 group by 1",
    "premiers_titulaires": f"select titulaire_nom, count(*) as marches, {O.half('sum(montant)', 2)} as total from {_NOW} and titulaire_nom is not null group by 1 order by marches desc, total desc nulls last, titulaire_nom limit 10",
    "extraits_montant": f"select id, montant, coalesce(acheteur_region_nom, '(inconnue)') as region from {_NOW} and montant < 1e9 order by montant desc, id limit 10",
    "signaux_page": "with s as (select * from signaux where signaux_forts >= 1 order by signaux_forts desc, ecart_normalise_famille desc nulls last, id limit 20), o as (select marche_id, id as ligne, objet, row_number() over (partition by marche_id order by id) as k from marches) select s.id, s.marche_id, s.signaux_forts, o.ligne, o.objet from s left join o on s.marche_id = o.marche_id and o.k = 1",
    "signaux_un_par_contrat": "select marche_id, id, signaux_forts from (select marche_id, id, signaux_forts, row_number() over (partition by marche_id order by signaux_forts desc, ecart_normalise_famille desc nulls last, id) as k from signaux) where k = 1 order by marche_id limit 10",
    "signaux_par_famille": "with m as (select * from marches where marche_id is not null and famille_cpv is not null), s as (select * from signaux where signaux_forts > 0) select b.famille_cpv, b.marches, coalesce(f.n, 0) as signales_joints, coalesce(r.n, 0) as signales_lignes from (select famille_cpv, count(*) as marches from m group by 1) b left join (select famille_cpv, count(*) as n from m join s on m.marche_id = s.marche_id group by 1) f using (famille_cpv) left join (select famille_cpv, count(*) as n from m where marche_id in (select marche_id from s) group by 1) r using (famille_cpv)".replace("select famille_cpv, count(*) as n from m join s", "select m.famille_cpv, count(*) as n from m join s"),
    "valeurs_distinctes": "select distinct acheteur_departement_code from marches where acheteur_departement_code is not null",
    "ids_dans_texte": r"with x as (select doc_id, list_distinct(regexp_extract_all(url, '\b(\d{6})\b', 1)) as ids from documents) select doc_id, list_contains(ids, '123456') as contient, unnest(list_filter(ids, lambda i: i <> '000000')) as numero from x",
    "semi_jointure": "select id, acheteur_siret from marches where acheteur_siret in ('99000103000019', '99000000200019', '99000104000018')",
    "identifiants_longs": "select id, substr(titulaire_siret, 1, 9) as siren from marches where length(titulaire_siret) <> 14 or contains(uid, '/')",
    "textes_courts": f"with x as (select id, {O.FOLD.format('objet')} as plie, trim(regexp_replace(objet, '\\s+', ' ', 'g')) as l from marches) select id, plie, case when length(l) <= 40 then l else (case when regexp_extract(left(l, 40), '^(.*) [^ ]*$', 1) = '' then left(l, 40) else regexp_extract(left(l, 40), '^(.*) [^ ]*$', 1) end) || '…' end as extrait from x",
    "regle_logarithmique": f"with x as (select famille_cpv, count(*) as n, round(log10(median(montant)), 6) as l from {_NOW} and montant > 0 and famille_cpv is not null group by 1), y as (select *, min(l) over () as lo, max(l) over () as hi, greatest(0.25, 0.12 * (max(l) over () - min(l) over ())) as g, max(n) over () as mx from x) select famille_cpv, cast(round(640 * (l - (lo - g)) / ((hi + g) - (lo - g))) as bigint) as place, cast(greatest(1.0, round(180.0 * n / mx)) as bigint) as barre from y",
    "json_evenements": """select case when contains(props, '"k"') then 'k' else 'autre' end as forme, count(*) as n, sum(cast(json_extract_string(props, '$.k') as bigint)) as somme from events group by 1""",
    "empreintes": "select doc_id, sha256(coalesce(text, '')) as empreinte from documents",
    "numeros_de_ligne": "select idweb, objet_decp, row_number() over (order by idweb, objet_decp) as ligne from (select distinct idweb, objet_decp from verdicts_rapprochement)",
    "somme_des_montants": f"select marche_id, count(*) as lignes, case when count(distinct montant) = 1 and count(montant) = count(*) then max(montant) end as montant from {_NOW} and marche_id is not null group by 1",
    "ratios_accueil": f"with x as (select marche_id, cast(round(montant * 100) as bigint) as c, titulaire_siret from {_NOW} and marche_id is not null and montant between 0 and 1e9), n as (select sum(c) as net from (select distinct marche_id, c from x)) select {O.half('100.0 * (sum(c) - max(net)) / max(net)', 4)} as surcompte, {O.half('100.0 * count(*) filter (where titulaire_siret is null) / count(*)', 4)} as inconnus from x, n",
    "delais": f"select source, count(*) as n, cast(median(j) as double) as mediane, {O.half('quantile_cont(j, 0.95)', 4)} as p95 from (select source, date_diff('day', date_notification, cast(date_publication as date)) as j from marches) where j between 0 and 120 group by 1",
    "phrase_mediane": f"with x as (select famille_cpv, median(montant) as m from {_NOW} and montant > 0 group by 1), t as (select median(montant) as t from {_NOW} and montant > 0) select famille_cpv, case famille_cpv when '33' then 'Matériels médicaux' when '45' then 'Travaux' when '79' then 'Services aux entreprises' else coalesce('Division ' || famille_cpv, 'Famille non precisee') end as libelle, case when m / t >= 2 then 'fois la médiane' when m / t > 1.05 then 'au-dessus de la médiane' when m / t < 0.95 then 'en dessous de la médiane' else 'proche de la médiane' end as phrase from x, t",
}
ORACLES = O.typed(ORACLES)
QUERIES = {n: globals()[n] for n in [*ORACLES, "recherche_densite", "vocabulaire_lexemes"]}
