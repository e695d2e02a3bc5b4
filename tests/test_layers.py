import datetime

import pytest
from pyspark.sql import functions as F

from ardoise.functions import columns as C
from ardoise.functions import text as T
from ardoise.operators import layers as L
from ardoise.operators.contracts import ContractError, Rule, check, enforce

DAY = datetime.date(2019, 5, 1)
GOOD = dict(id=1, marche_id="m", donneesActuelles=True, nature="Marché", procedure=" accord-cadre ", montant=1000.0, montant_anomalie=None, date_notification=DAY, duree_mois=12, acheteur_siret="1" * 14, titulaire_siret="2" * 14, code_cpv="45000000", offres_recues=1)
TYPES = "id long, marche_id string, donneesActuelles boolean, nature string, procedure string, montant double, montant_anomalie string, date_notification date, duree_mois int, acheteur_siret string, titulaire_siret string, code_cpv string, offres_recues int"


def silver(spark, **change):
    return L.silver(spark.createDataFrame([tuple((GOOD | change).values())], TYPES)).first()


def test_a_healthy_row_is_clean(spark):
    r = silver(spark)
    assert r.motifs_rejet == [] and r.exploitable_pour_les_prix and r.nature_normalisee == "MARCHE" and r.procedure_normalisee == "ACCORD CADRE"


@pytest.mark.parametrize(
    ("flag", "change", "gates"),
    [
        ("montant_renseigne", {"montant": -1.0}, True), ("montant_plausible", {"montant": 2e9}, True), ("montant_sans_anomalie_signalee", {"montant_anomalie": "suspect"}, True),
        ("date_plausible", {"date_notification": datetime.date(2001, 1, 1)}, True), ("duree_plausible", {"duree_mois": 0}, False), ("acheteur_siret_valide", {"acheteur_siret": None}, True),
        ("titulaire_siret_valide", {"titulaire_siret": "12"}, False), ("cpv_conforme", {"code_cpv": "travaux"}, False), ("offres_plausibles", {"offres_recues": 501}, False),
    ],
)
def test_each_defect_is_flagged(spark, flag, change, gates):
    r = silver(spark, **change)
    assert r[flag] is False and len(r.motifs_rejet) == 1 and r.exploitable_pour_les_prix is (not gates)


def test_missing_values(spark):
    r = silver(spark, montant=None, date_notification=None, duree_mois=None, titulaire_siret=None, code_cpv=None, offres_recues=None)
    assert len(r.motifs_rejet) == 3 and not r.exploitable_pour_les_prix


def test_old_rows_leave_the_perimeter(spark):
    assert L.silver(spark.createDataFrame([tuple((GOOD | {"donneesActuelles": False}).values())], TYPES)).count() == 0


def test_contracts(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    rules = [Rule("a", "error", F.col("x") > 0), Rule("b", "warn", F.col("x") > 5)]
    assert [tuple(r) for r in check(df, rules).collect()] == [("a", "error", 1), ("b", "warn", 2)]
    with pytest.raises(ContractError):
        enforce(df, rules)
    assert enforce(df, rules[1:]) is df


def test_text_functions(spark):
    df = spark.createDataFrame([("  École-Élémentaire  d'été ", "un deux trois")], "a string, b string")
    r = df.select(T.fold(F.col("a")).alias("f"), T.excerpt(F.col("b"), 9).alias("e"), T.excerpt(F.lit("x" * 20), 9).alias("h"), T.contract_number(F.lit(None).cast("string"), F.lit("profil/2019 00000222 u ")).alias("n")).first()
    assert tuple(r) == ("ecole elementaire d ete", "un deux…", "x" * 9 + "…", "2019-00000222-U")


def test_number_functions(spark):
    lo, hi = C.wilson(F.lit(0), F.lit(0))
    r = spark.range(1).select(lo, hi, C.percent(F.lit(1), F.lit(0)), C.french_decimal(F.lit("1 234,5")), C.french_decimal(F.lit("-3")), C.french_euros(F.lit(1.5e6)), C.french_euros(F.lit(2.5e9)), C.half_up(F.lit(0.145), 2)).first()
    assert tuple(r) == (0.0, 100.0, None, 1234.5, None, "1,5 million", "2,5 milliards", 0.15)
