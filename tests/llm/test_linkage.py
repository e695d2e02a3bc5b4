import datetime as dt

from ardoise.llm import linkage as L

M = "id long, marche_id string, uid string, objet string, acheteur_nom string, acheteur_commune_nom string, acheteur_siret string, titulaire_nom string, date_notification date, montant double, famille_cpv string, source string, _c string"
A = "idweb string, objet_boamp string, acheteur_nom string, ville string, date_parution date, montant_estime double, famille_cpv string, titulaire_nom string"
THINGS = ["toiture", "ascenseurs", "mobilier", "chaudiere", "signaletique", "vetements"]
WORKS = ["Fourniture", "Location", "Remplacement"]


def town(k):
    return "".join("bcdfglmnprst"[(k * 7 + j * 5 + k // (j + 2)) % 12] + "aeiou"[(k + j * 3 + k // (j + 1)) % 5] for j in range(5))


def contracts():
    rows = []
    for k in range(240):
        place = "z" + town(k * 3 + 1) + "x"
        rows.append((k, f"2019-{k:08d}-A", None, f"{WORKS[k % 3]} de {THINGS[k % 6]} - école {place.capitalize()}", f"Commune de {town(k % 20).capitalize()}", town(k % 20), f"{k % 20:014d}", f"Firme{town(k % 40)}", dt.date(2019, 1 + k % 12, 3), 1000.0 * (k + 1) * (100 if k % 4 == 0 else 1), f"{k % 9:02d}", "cents" if k % 4 == 0 else "euros", "x"))
    return rows


def notice(k, **change):
    c = contracts()[k]
    place = c[3].split()[-1]
    base = {"idweb": f"n{k}", "objet": f"ÉCOLE {place.upper()} : {['achat', 'mise à disposition', 'renouvellement'][k % 3]} {THINGS[k % 6]}", "acheteur": f"MAIRIE DE {town(k % 20).upper()}", "ville": None, "date": c[8] - dt.timedelta(days=80), "montant": 1000.0 * (k + 1) * 1.1, "famille": c[10], "titulaire": None}
    return tuple((base | change).values())


def test_links_hard_negatives_repeats_and_nulls(spark):
    m = spark.createDataFrame(contracts(), M)
    notices = [notice(k) for k in range(0, 60, 3)] + [notice(0), notice(70, objet=None, acheteur=None, famille=None), notice(80, objet="École Introuvable : achat piano", acheteur="Mairie de Nullepart")]
    notices.append(notice(91, objet="Ecole z" + town(91 * 3 + 1) + "x : achat " + THINGS[90 % 6]))  # the place of one contract, the thing of another
    notices.append((None, *notice(93)[1:]))
    got = {r.idweb: r for r in L.link(spark.createDataFrame(notices, A), m).collect()}
    for k in range(0, 60, 3):
        assert got[f"n{k}"].marche_id == f"2019-{k:08d}-A" and got[f"n{k}"].part > 0.5
    for n in ("n70", "n80", "n91"):
        assert n not in got or got[n].part < 0.5
    assert None not in got and len(got) == len(set(got))


def test_empty_tables(spark):
    m, a = spark.createDataFrame(contracts()[:5], M), spark.createDataFrame([notice(1)], A)
    assert L.link(a.limit(0), m).count() == 0
    assert L.link(a, m.limit(0)).count() == 0


def test_near_and_usual_words():
    assert L.near("toiture", "toitue") and L.near("mobilier", "mobiiler") and not L.near("lits", "lots") and not L.near("toiture", "peinture")
    u = L.Usual(["toiture"])
    assert "toitue" in u and "toiture" in u and "zabrolix" not in u and u.places(["toitue", "zabrolix", "amo"]) == ["zabrolix"]


def test_notices_are_found_by_place_and_word_with_another_buyer_and_by_buyer_and_month_with_another_place(spark):
    m = contracts()
    bare = list(m[150])
    bare[3], bare[4], bare[5] = f"Fourniture de {THINGS[150 % 6]}", "Commune de Quvoxaria", "Quvoxaria"
    m[150] = tuple(bare)
    place = m[60][3].split()[-1]
    wrong = place[:2] + ("b" if place[2] != "b" else "c") + place[3:]
    notices = [notice(3), notice(60, objet=f"École {wrong} : achat {THINGS[0]}", acheteur="Mairie de Trovimelan"), notice(150, objet=f"École Lirobandexu : achat {THINGS[0]}", acheteur="Mairie de Quvoxaria")]
    got = {r.idweb: r for r in L.link(spark.createDataFrame(notices, A), spark.createDataFrame(m, M)).collect()}
    for k in (3, 60, 150):
        assert got[f"n{k}"].marche_id == f"2019-{k:08d}-A" and got[f"n{k}"].part > 0.5


def edges_of(spark):
    # The spelling "b" goes with two buyers; "t" is the second of the suppliers of its contracts.
    rows = [(f"n{k}", f"c{k % 7}{m}", 2.0 + 0.3 * m + 0.1 * (k % 4), f"A{(k + m) % 3}", "b" if k % 2 else "d", "t" if k % 3 else None, ["s", f"t{k % 2}"], None) for k in range(24) for m in range(3)]
    return spark.createDataFrame(rows, L.EDGE)


def test_propagation_ends_in_a_settled_state_or_raises(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(L, "STILL", 1e-8)
    final = L.propagate(edges_of(spark)).cache()
    again = L._shares(final.withColumnRenamed("part", "_p").join(L._support(final), ["idweb", "contrat"], "left").fillna(0.0, ["dit"]).withColumn("total", final["score"] + L.SUPPORT * L.F.col("dit")))
    assert again.agg(L.F.max(L.F.abs(again["part"] - again["_p"]))).first()[0] < 1e-7
    monkeypatch.setattr(L, "STILL", -1.0)
    monkeypatch.setattr(L, "ROUNDS", 3)
    with pytest.raises(RuntimeError):
        L.propagate(edges_of(spark))


def test_every_supplier_and_every_name_of_a_buyer_takes_part(spark):
    import pyarrow as pa

    rows = [("n1", "c1", 5.0, None, None, "x", ["alpha", "zeta"], None), ("n2", "c2", 5.0, None, None, "x", ["beta", "zeta"], None)]
    says = {r.idweb: r.dit for r in L._support(L._shares(spark.createDataFrame(rows, L.EDGE).withColumn("total", L.F.col("score")))).collect()}
    assert says["n1"] > 0.4 and says["n2"] > 0.4
    batch = pa.RecordBatch.from_pylist([{"ident": "a", "mots": [], "acheteur": "Quvoxaria Lirobandex Trovimelan Zabrolix Munodeka", "commune": None, "titulaires": [], "mois": None}])
    assert len(next(iter(L._read_records([], [], [])(iter([batch])))).to_pylist()[0]["noms"]) == 5


def patterns(rows):
    import pandas as pd

    names = list(L.LEVELS)
    return pd.DataFrame([{**dict.fromkeys(names, 0), **levels, "n": n, "oui": yes, "non": no} for levels, n, yes, no in rows])


def test_weights_follow_judged_pairs_and_bear_wrong_verdicts():
    same = {"objet": 16, "travail": 2, "acheteur": 3, "genre": 2, "delai": 2}
    other = same | {"objet": 14}  # the place of one purchase, the thing of another
    weights, share = L.learn_weights(patterns([(same, 900, 60, 2), (other, 5000, 2, 60), ({}, 10, 0, 0)]))
    assert weights["objet"][16] > 2 and weights["objet"][14] < -4 and 0.05 < share < 0.3
    assert all(w[0] == 0.0 for w in weights.values())
    # Without verdicts the shares to begin with decide.
    bare, _ = L.learn_weights(patterns([(same, 900, 0, 0), (other, 5000, 0, 0)]))
    assert bare["objet"][16] > bare["objet"][14]


def test_a_contract_goes_to_the_notice_with_the_larger_share(spark):
    rows = [("n1", "c1", 4.0, None, None, None, [], None), ("n2", "c1", 6.0, None, None, None, [], None), ("n2", "c2", 1.0, None, None, None, [], None), ("n1", "c3", 3.0, None, None, None, [], None), ("n3", "c3", 9.0, None, None, None, [], None)]
    x = L._shares(spark.createDataFrame(rows, L.EDGE).withColumn("total", L.F.col("score")))
    got = {(r.idweb, r.contrat): r.part for r in L.one_to_one(x).collect()}
    assert ("n1", "c1") not in got and ("n1", "c3") not in got and got["n2", "c1"] > 0.9 and got["n3", "c3"] > 0.9


def test_split_blocks_give_the_same_graph(spark, monkeypatch):
    records = lambda n, same: spark.createDataFrame([(f"{same}{k}", [1, 100 + k % 3], [1, 100 + k % 3, 7]) for k in range(n)], "ident string, cles array<bigint>, cles_toutes array<bigint>")
    whole = {tuple(r) for r in L.candidates(records(5, "n"), records(40, "c")).collect()}
    monkeypatch.setattr(L, "BLOCK_CONTRACTS", 3)
    assert {tuple(r) for r in L.candidates(records(5, "n"), records(40, "c")).collect()} == whole and len(whole) > 5
    monkeypatch.setattr(L, "KEYS_BROADCAST", 0)
    assert {tuple(r) for r in L.candidates(records(5, "n"), records(40, "c")).collect()} == whole


def test_keys_of_a_notice_meet_those_of_its_contract():
    def meet(notice, contract, narrow=True):
        return set(L.keys_of(*notice, L.MONTHS, True, narrow)) & set(L.keys_of(*contract, 0, False, False))

    contract = (["location", "toiture", "zabrolixene"], ["zabrolixene"], ["quvoxaria"], ["firmenom"], 24_000, "location")
    assert meet((["toiture", "zabrolixene"], ["zabrolixene"], [], [], None, ""), contract)
    # A misspelt place with the buyer; no place, but buyer or supplier in a month before.
    assert meet((["toiture", "zabrolixxne"], ["zabrolixxne"], ["quvoxaria"], [], None, ""), contract)
    assert meet((["toiture"], [], ["quvoxaria"], [], 23_990, "location"), contract) and meet((["toiture"], [], [], ["firmenom"], 23_990, ""), contract)
    assert not meet((["toiture"], [], ["quvoxaria"], [], 23_990, "fourniture"), contract) and not meet((["toiture"], [], ["quvoxaria"], [], 24_001, "location"), contract)
    assert len(L.keys_of([], [], [], [], None, "", 0, False, False)) == 0


def test_keys_that_no_notice_has_are_left_out(spark):
    import types

    import pyarrow as pa

    from ardoise.llm.leaks import bitmap_of

    rows = [{"ident": k, "mots": ["toiture", place], "acheteur": "Commune de Quvoxaria", "commune": None, "titulaires": [], "mois": 24_000} for k, place in (("a", "zabrolixene"), ("b", "lirobandexu"))]
    read = lambda **how: next(iter(L._read_records(["toiture"], ["toiture"], [], **how)(iter([pa.RecordBatch.from_pylist(rows)])))).to_pylist()
    every = [set(r["cles_toutes"]) for r in read()]
    own = sorted(every[0] - every[1])
    bits = bitmap_of(spark.createDataFrame([(k,) for k in own[:5]], "trace long"))
    got = [set(r["cles_toutes"]) for r in read(wanted=types.SimpleNamespace(value=bits))]
    assert len(own) > 5 and set(own[:5]) <= got[0] <= every[0] and len(got[0]) == 5 and got[1] == set()


def test_edges_just_at_the_bound_stay_however_weights_are_summed(spark):
    m, a, p, b = 9, 6, 9, 2
    keys = {f"x{k}": list(range(a)) for k in range(m)} | {f"y{k}": list(range(100, 100 + b)) for k in range(p)}
    contracts = spark.createDataFrame([(c, k, k) for c, k in keys.items()], "ident string, cles array<bigint>, cles_toutes array<bigint>")
    every = sorted({k for own in keys.values() for k in own})
    # The weight b / p is half of the mean (a + b) / (m + p), but not so in floating point.
    got = {r.contrat for r in L.candidates(spark.createDataFrame([("n", every, every)], contracts.schema), contracts).collect()}
    assert b / p == L.PRUNE * (a + b) / (m + p) and got == set(keys)
