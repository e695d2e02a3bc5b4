import random

from pyspark.sql import functions as F

from ardoise.llm import packing as P


def brute(sizes, capacity):
    room, out = [], []
    for s in sizes:
        k = next((i for i, r in enumerate(room) if r >= s), len(room))
        if k == len(room):
            room.append(capacity)
        room[k] -= s
        out.append(k)
    return out


def test_tournament_equals_first_fit():
    r = random.Random(2)
    for _ in range(30):
        sizes = sorted((r.randint(1, 50) for _ in range(r.randint(0, 80))), reverse=True)
        assert P.first_fit_decreasing(sizes, 50) == brute(sizes, 50)


def test_every_text_whole_and_no_container_too_full(spark):
    r = random.Random(4)
    rows = [(i // 2, r.choice([0, 1, 5, 30, 64, 65, 200])) for i in range(400)]
    out = P.pack(spark.createDataFrame(rows, "doc_id long, tokens long"), [(1, 64), (2, 100), (3, 0)], group_texts=90).collect()
    full, text = {}, {}
    for x in out:
        full[x.contenant_id, x.groupe, x.conteneur] = full.get((x.contenant_id, x.groupe, x.conteneur), 0) + x.tokens
        text.setdefault((x.contenant_id, x.ligne), []).append(x)
    capacity = {1: 64, 2: 100}
    assert all(v <= capacity[k[0]] for k, v in full.items())
    for c in capacity:
        assert sum(x.tokens for x in out if x.contenant_id == c) == sum(t for _, t in rows)
        used = [v for k, v in full.items() if k[0] == c]
        assert sum(used) / (len(used) * capacity[c]) > 0.9
    for (c, _), pieces in text.items():
        pieces.sort(key=lambda x: x.morceau)
        assert all(x.tokens == capacity[c] for x in pieces[:-1]) and [x.debut for x in pieces] == [capacity[c] * k for k in range(len(pieces))]


def test_counts_are_those_of_the_tokenizer_and_empty_texts_take_no_room(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "数" * 3000)], "doc_id long, text string")
    n = {r.doc_id: r.tokens for r in P.token_counts(df).collect()}
    assert n[1] == 2 and n[2] == n[3] == 0 and n[4] > 1000
    out = P.packed_documents(df, [(1, 512)])
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {1, 4}
    assert P.packed_documents(df.limit(0), [(1, 512)]).count() == 0 and P.packed_documents(df, [(1, 0)]).count() == 0
    assert out.filter(F.col("doc_id") == 4).agg(F.sum("tokens")).first()[0] == n[4]


def test_full_pieces_of_long_texts_join_no_group(spark):
    rows = [(1, 10_000), (2, 9_995), (3, 4), (4, 7)]
    out = P.pack(spark.createDataFrame(rows, "doc_id long, tokens long"), [(1, 10)], group_texts=10).collect()
    assert sum(x.tokens for x in out) == sum(t for _, t in rows)
    packed = [x for x in out if x.groupe >= 0]
    assert sorted(x.tokens for x in packed) == [4, 5, 7] and all(x.tokens == 10 for x in out if x.groupe < 0)
    assert len({(x.groupe, x.conteneur) for x in out}) == 1999 + 2
