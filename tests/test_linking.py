import datetime
import random
from difflib import SequenceMatcher

import numpy as np

from ardoise.operators import linking as L


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def test_common_subsequence_of_many_texts():
    rng = random.Random(1)
    text = lambda: "".join(rng.choice("abcé 1😀") for _ in range(rng.choice((0, 1, 40, 63, 64, 65, 150))))
    for _ in range(12):
        a, texts = text(), [text() for _ in range(20)]
        assert L.common_subsequence(a, texts).tolist() == [_lcs(a, t) for t in texts]


def test_most_similar_equals_comparing_all(spark, monkeypatch):
    # No text is compared that its bound rules out, yet buyers cut into spans give what all comparisons give.
    monkeypatch.setattr(L, "BUYER_PAIRS", 300)
    rng, day = random.Random(2), lambda k: datetime.date(2018, 1, 1) + datetime.timedelta(k)
    words = ["travaux", "toiture", "École", "achat", "de", "repas", "éclairage", "maintenance", "stade", "lot 2"]
    subject = lambda: rng.choice([None, "", *[" ".join(rng.choices(words, k=rng.randint(1, 20))) for _ in range(8)]])
    notices = [(f"n{k}", subject(), rng.choice(["Ville A", "VILLE  a", "B", None]), day(rng.randrange(2000)) if k % 9 else None) for k in range(80)]
    contracts = [(k, subject(), rng.choice(["ville a", "B", "C", None]), day(rng.randrange(2500)) if k % 11 else None) for k in range(500)]
    n, c = spark.createDataFrame(notices, "idweb string, objet_boamp string, acheteur_nom string, date_parution date"), spark.createDataFrame(contracts, "id long, objet string, acheteur_nom string, date_notification date")
    want = {}
    key = lambda s: s and s.lower().replace("  ", " ")
    for idweb, a, who, p in notices:
        pairs = [(SequenceMatcher(None, a, b).ratio(), -i) for i, b, whom, d in contracts if None not in (a, b, who, whom, p, d) and key(who) == key(whom) and -L.BEFORE <= (d - p).days <= L.AFTER]
        if pairs:
            want[idweb] = (-max(pairs)[1], max(pairs)[0])
    got = L.most_similar(n, c).collect()
    assert len(got) == len(want) > 20 and {r.idweb: (r.id, r.ratio) for r in got} == want


def test_most_texts_are_not_compared(monkeypatch):
    asked = []

    class Counting(SequenceMatcher):
        def ratio(self):
            asked.append(1)
            return super().ratio()

    monkeypatch.setattr(L, "SequenceMatcher", Counting)
    rng = random.Random(3)
    contracts = [(0, k, "".join(rng.choices("abcdefghijklmnop ", k=50))) for k in range(3000)]
    found = list(L._best_of_buyer([("n", 0, contracts[1234][2])], contracts, np.zeros(L.CODES, np.uint64)))
    assert found == [("n", 1234, 1.0)] and len(asked) < 50
