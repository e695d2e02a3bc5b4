import datetime as dt

from ardoise.llm import survivors as S

COLUMNS = {"id": "long", "marche_id": "string", "uid": "string", **{c: "string" for c in S.CONTENT if c not in ("montant", "duree_mois", "offres_recues", "distance_km", "date_notification")}, "montant": "double", "duree_mois": "short", "offres_recues": "short", "distance_km": "short", "date_notification": "date", "modification_id": "short", "donneesActuelles": "boolean", "date_publication": "timestamp", "contrat": "string"}
BASE = {c: "x" for c, t in COLUMNS.items() if t == "string"} | {"uid": None, "titulaire_siret": "12345678900011", "titulaire_nom": "Firme", "objet": "Fourniture de tables pour une école", "montant": 12345.67, "duree_mois": 5, "offres_recues": 2, "distance_km": 3, "date_notification": dt.date(2019, 1, 1), "donneesActuelles": True}


def row(i, contract=1, day=1, version=None, **change):
    return BASE | {"id": i, "marche_id": f"2019-0000000{contract}-A", "modification_id": version, "date_publication": dt.datetime(2019, 1, 1) + dt.timedelta(days=day)} | change


def ladder(first, contract):
    """An award whose versions say that the duration only grows; teaches the currency field."""
    return [row(first + k, contract, k, k, duree_mois=5 + 2 * k, montant=1000.11 + k) for k in range(9)]


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], ", ".join(f"`{c}` {t}" for c, t in COLUMNS.items()))


def best(spark, rows):
    teach = [r for k in (7, 8, 9) for r in ladder(1000 * k, k)]
    return {r.id_groupe: r.id for r in S.survivors(frame(spark, rows + teach)).collect() if r.id_groupe < 1000}


def test_last_stated_version_wins_over_a_late_republication(spark):
    assert best(spark, [row(1, version=0), row(2, day=5, version=1, duree_mois=7, montant=13000.01), row(3, day=90, version=0)]) == {1: 2}


def test_careless_copies_lose(spark):
    assert best(spark, [row(1, version=0), row(2, day=9, version=0, montant=12000.0), row(3, day=10, version=0, objet="Fourniture de tab..."), row(4, day=11, version=1, montant=None, duree_mois=None, titulaire_siret=None)]) == {1: 1}


def test_currency_orders_rows_without_version(spark):
    rows = [row(1, day=1, duree_mois=5, montant=1.11), row(2, day=2, duree_mois=9, montant=3.33), row(3, day=9, duree_mois=7, montant=2.22)]
    assert best(spark, rows) == {1: 2}
    assert best(spark, [row(1, version=0), row(2, day=3, duree_mois=7, montant=14000.02), row(3, day=80, version=0, uid="late")]) == {1: 2}


def test_dates_tell_where_nothing_else_does(spark):
    assert best(spark, [row(1, day=1, duree_mois=None, montant=1.11), row(2, day=4, duree_mois=None, montant=2.22)]) == {1: 2}


def test_exact_repeats_suppliers_and_number_spellings(spark):
    assert best(spark, [row(5), row(6), row(7)]) == {5: 5}
    assert best(spark, [row(1), row(2, titulaire_siret="99999999900011", titulaire_nom="Autre")]) == {}
    assert best(spark, [row(1, version=0), row(2, day=2, version=1, marche_id=None, uid="profil/2019 00000001 a", titulaire_siret="12345678900029", duree_mois=7), row(3, version=0, titulaire_siret=None)]) == {1: 2}


def test_null_numbers_and_empty_table(spark):
    assert best(spark, [row(1, marche_id=None), row(2, marche_id=None)]) == {}
    assert S.survivors(frame(spark, [])).count() == 0


def test_fused_takes_the_latest_value_that_is_there(spark):
    rows = [row(1, version=0, offres_recues=4, code_cpv="old"), row(2, day=3, version=1, duree_mois=7, offres_recues=None, code_cpv="new")]
    x = S.fused(frame(spark, rows + ladder(1000, 9)), ["offres_recues", "code_cpv", "objet"]).filter("id_groupe = 1").first()
    assert (x.offres_recues, x.code_cpv, x.lignes) == (4, "new", 2)
