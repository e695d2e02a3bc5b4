import random

import pytest

from ardoise.llm import names as N
from ardoise.llm import trie_join as T
from ardoise.llm.variants import spellings, variant_pairs


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@pytest.mark.parametrize("bound", [1, 2])
def test_trie_join_equals_brute_force(spark, bound, monkeypatch):
    r = random.Random(bound)
    words = {"".join(r.choice("abc") for _ in range(r.randint(4, 8))) for _ in range(120)}
    words |= {w[:2] + w[3] + w[2] + w[4:] for w in list(words)[:30]} | {"x", "abcd", ""}
    df = spark.createDataFrame([("g", w) for w in words] + [("g", None), ("h", "abcd")], "groupe string, mot string")
    want = {(a, b, osa(a, b)) for a in words for b in words if len(a) >= 4 and len(b) >= 4 and osa(a, b) <= bound}
    for shard in (20_000, 3):
        monkeypatch.setattr(T, "SHARD_STRINGS", shard)
        rows = T.trie_join(df, df, bound).collect()
        assert {(x.sonde, x.mot, x.distance) for x in rows if x.groupe == "g"} == want
        assert [(x.sonde, x.mot) for x in rows if x.groupe == "h"] == [("abcd", "abcd")]
    assert T.trie_join(df.limit(0), df, bound).count() == 0


def test_reading_names():
    assert N.words("C.C.A.S. d'Ébène-le-Haut") == ["ccas", "d", "ebene", "le", "haut"]
    assert N.read(N.words("Ctre communal action sociale Trucville"))[0] == N.read(N.words("CCAS DE TRUCVILLE"))[0] == "ccas"
    assert N.read(N.words("Mairie de Trucville")) == ("commune", "", ["trucville"])
    assert N.read(N.words("SARL Machin Maçonnerie")) == ("", "sarl", ["machin", "maconnerie"])
    assert N.covers(frozenset(["ev"]), frozenset(["espaces", "verts"])) and N.covers(frozenset("v"), frozenset(["valentine"])) and not N.covers(frozenset(["tp"]), frozenset(["mobilier"]))


NAMES = (
    ["Commune de Rostelbarg"] * 9 + ["MAIRIE DE ROSTELBARG", "Ville de Rostlebarg", "Rostelbarg, mairie", "Commune de Ros telbarg", "CCAS de Rostelbarg", "C.C.A.S. ROSTELBARG", "Centre communal d'action sociale de Rostelbarg"]
    + ["Commune de Vindomarche-le-Haut"] * 4 + ["CNE DE VINDOMARCHE"] + [None, "", "---"]
)
FIRMS = ["Polumbrac Espaces Verts SAS"] * 6 + ["SAS POLUMBRAC ESPACES VERTS", "Polumbrac EV", "Polumbrac Mobilier SA", "Ets Polumbrac Mobilier", "Sté Polumbrac"] + ["Valentine Kermadec"] * 5 + ["KERMADEC VALENTINE", "V. Kermadec", "Val Kermadec", "Alexandre Kermadec"]
# Other firms and persons, so that words of activities and first names are seen beside many names.
OTHERS = [f"{n} {a} SAS" for n in ("Bertolune", "Cramisole", "Dufrangel", "Esticorne", "Fauvilard", "Grimbosca") for a in ("Espaces Verts", "Mobilier")] + [f"{p} {n}" for n in ("Hortesane", "Isolambre", "Jurdanois", "Lestrigon") for p in ("Valentine", "Alexandre")]


def test_variants_of_bodies_firms_and_persons(spark):
    df = spark.createDataFrame([("a", n) for n in NAMES] + [("t", n) for n in FIRMS + OTHERS], "champ string, nom string")
    groups = {}
    for r in spellings(df).collect():
        groups.setdefault((r.champ, r.entite), set()).add(r.nom)
    sets = list(groups.values())
    assert {"Commune de Rostelbarg", "MAIRIE DE ROSTELBARG", "Ville de Rostlebarg", "Rostelbarg, mairie", "Commune de Ros telbarg"} in sets
    assert {"CCAS de Rostelbarg", "C.C.A.S. ROSTELBARG", "Centre communal d'action sociale de Rostelbarg"} in sets
    assert {"Commune de Vindomarche-le-Haut", "CNE DE VINDOMARCHE"} in sets
    assert {"Polumbrac Espaces Verts SAS", "SAS POLUMBRAC ESPACES VERTS", "Polumbrac EV"} in sets and {"Polumbrac Mobilier SA", "Ets Polumbrac Mobilier"} in sets
    assert {"Sté Polumbrac"} in sets  # fits two firms
    assert {"Valentine Kermadec", "KERMADEC VALENTINE", "V. Kermadec", "Val Kermadec"} in sets and {"Alexandre Kermadec"} in sets
    pairs = variant_pairs(df).collect()
    assert len(pairs) == sum(len(s) * (len(s) - 1) // 2 for s in sets) and all(p.nom_a.encode() < p.nom_b.encode() for p in pairs)


def test_empty(spark):
    assert variant_pairs(spark.createDataFrame([], "champ string, nom string")).count() == 0
    assert variant_pairs(spark.createDataFrame([("a", None), ("a", "  ")], "champ string, nom string")).count() == 0


def test_no_table_that_grows_with_the_names_is_broadcast(spark, monkeypatch):
    from ardoise.llm import variants as V

    plans = []

    def written(df, name, kept=V.materialise):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(V, "materialise", written)
    df = spark.createDataFrame([("a", n) for n in NAMES] + [("t", n) for n in FIRMS + OTHERS], "champ string, nom string")
    pairs = variant_pairs(df)
    plans.append(pairs._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and "SortMergeJoin" in plans[-1] and not [p for p in plans if "BroadcastHashJoin" in p]
