import random

import numpy as np

from ardoise.llm import leaks as L

R = random.Random(3)
WORDS = ["lantern", "kettle", "orchard", "compass", "chimney", "trumpet", "beehive", "cradle", "frozen", "amber", "crosses", "mimics", "beneath", "polishes", "spindle", "ladder", "harbour", "window"]
ITEMS = [(i, " ".join(R.choice(WORDS) + str(R.randrange(90)) for _ in range(40))) for i in range(30)]


def found(spark, docs, least=0.3, items=ITEMS):
    d = spark.createDataFrame(docs, "doc_id long, text string, part int" if docs and len(docs[0]) == 3 else "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in L.leaks(d, i, least).collect()}


def test_whole_partial_changed_and_interrupted_items(spark):
    w = ITEMS[4][1].split()
    docs = [
        (1, "Intro text. " + ITEMS[3][1] + " The end."), (2, "A page. " + " ".join(w[5:25]) + " and more"), (3, " ".join(w[:5])),
        (4, "; ".join(ITEMS[5][1].upper().split())), (5, " ".join("changed" if k in (9, 22) else x for k, x in enumerate(ITEMS[6][1].split()))),
        (6, " ".join(ITEMS[7][1].split()[:20]) + "\nHome | Contact | Press and news of today\n" + " ".join(ITEMS[7][1].split()[20:])), (7, "Nothing to see here"), (8, None), (9, ""),
    ]
    assert found(spark, docs) == {(1, 3), (2, 4), (4, 5), (5, 6), (6, 7)}


def common(item, page):
    """Whether item and page share a fingerprint, with a filter that lets exactly the item's through."""
    own, _ = L.item_prints(item)
    k, winnowed = L.gram_size(len(item))
    return len(L.page_prints(page, lambda h: np.isin(h, own), [] if winnowed else [k], winnowed)[0]) > 0


def random_bytes(r, n):
    return r.integers(97, 123, n).astype(np.uint8)


def test_every_shared_span_of_the_guaranteed_length_is_hit():
    r = np.random.default_rng(1)
    item = random_bytes(r, 400)
    for _ in range(200):
        a = int(r.integers(0, 400 - 22))
        assert common(item, np.concatenate([random_bytes(r, 50), item[a : a + L.K + L.WINDOW - 1], random_bytes(r, 50)]))


def test_a_third_of_an_item_of_any_length_is_hit():
    r = np.random.default_rng(2)
    for size in (15, 16, 18, 20, 21, 22, 30, 44, 45, 54, 60, 65, 66, 67, 90):
        third = -(-size // 3)
        for _ in range(100):
            item = random_bytes(r, size)
            a = int(r.integers(0, size - third + 1))
            assert common(item, np.concatenate([random_bytes(r, 40), item[a : a + third], random_bytes(r, 40)])), size
            assert common(item, np.concatenate([random_bytes(r, 40), item, random_bytes(r, 40)])), size


def test_grams_of_different_size_have_different_hashes_and_equal_ones_equal():
    r = np.random.default_rng(3)
    b = random_bytes(r, 60)
    for k in range(1, 16):
        h = L.gram_hashes(b, k)
        assert len(h) == 61 - k and L.gram_hashes(b[7 : 7 + k], k)[0] == h[7]
        assert not set(h.tolist()) & set(L.gram_hashes(b, k % 15 + 1).tolist())


def test_short_items_come_out_of_pages(spark):
    items = [(1, "quick amber kettle"), (2, "the harbour window is frozen over tonight and tomorrow"), (3, "zebra")]
    docs = [(1, "A page about the quick amber kettle."), (2, "He said the harbour window is closed"), (3, "ze bra and amber"), (4, "amber window")]
    assert found(spark, docs, items=items) == {(1, 1), (2, 2), (3, 3), (3, 1), (4, 1)} - {(3, 1), (4, 1)}


def test_wrong_charset_accents_and_repeats(spark):
    text = "Élève près de l'été, garçon naïf où çà, déjà-vu brûlé, forêt pâle " * 2
    items = [(1, text), (2, text)]
    assert found(spark, [(1, text.encode().decode("latin-1")), (1, text), (2, text.replace("é", "e"))], items=items) == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_short_items_shuffled_joins_and_empty_tables(spark, monkeypatch):
    assert found(spark, [(1, "one tiny thing"), (2, "other")], items=[(1, "tiny"), (2, ""), (3, None)]) == {(1, 1)}
    assert found(spark, [], items=ITEMS) == set()
    assert found(spark, [(1, "x")], items=[]) == set()
    monkeypatch.setattr(L, "BROADCAST_PRINTS", 0)
    monkeypatch.setattr(L, "BROADCAST_BYTES", 0)
    assert found(spark, [(1, ITEMS[3][1], 0), (2, ITEMS[29][1], 0)]) == {(1, 3), (2, 29)}


def test_a_chain_is_found_however_often_the_page_repeats_the_passage(spark):
    parts = [(0, 50), (60, 110), (120, 170), (180, 230)]
    for copies in (1, 63, 64, 500):
        assert L._longest([(a, b, 2000 * k + a, 2000 * k + b) for k in range(copies) for a, b in parts]) == (0, 230)
    # Every fifth word of a page of ninety copies is changed, in each copy by another word.
    words = ITEMS[8][1].split()
    page = "\n".join(" ".join(f"{w[::-1]}{k}" if n % 5 == 4 else w for n, w in enumerate(words[:24])) + " filler" * 120 for k in range(90))
    assert found(spark, [(1, page)]) == {(1, 8)}


def test_one_whole_line_of_any_length_may_interrupt(spark):
    w = ITEMS[9][1].split()
    # A fifth of the item before the line and a fifth after it.
    line = " ".join(f"menu{k}" for k in range(700))
    half = "\n".join([" ".join(w[8:16]), line, " ".join(w[16:24])])
    two = "\n".join([" ".join(w[8:16]), line, line, " ".join(w[16:24])])
    assert found(spark, [(1, half), (2, two), (3, half.replace("\n", " ")), (4, half.replace("\n", "\r\n"))]) == {(1, 9), (4, 9)}
