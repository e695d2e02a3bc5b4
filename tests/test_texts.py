import pytest
from pyspark.sql import functions as F

from ardoise.functions.snowball import stem, stems
from ardoise.functions.text import trigrams

# Words and stems of the published sample vocabulary.
PUBLISHED = """continu continu continuait continu continuation continu continuel continuel continuellement continuel continuera continu continuité continu contorsions contors contournait contourn
contraction contract contradictoirement contradictoir contraindre contraindr contraintes contraint contraria contrari main main maintenant mainten maintenir mainten maintenue maintenu maintien maintien
maires mair mairie mair maïs maï maisons maison maître maîtr maîtresse maîtress majesté majest majestueuse majestu majestueusement majestu majestueux majestu majeure majeur majorité major malades malad maladies malad maladive malad""".split()


@pytest.mark.parametrize(("word", "expected"), list(zip(PUBLISHED[::2], PUBLISHED[1::2])))
def test_stems_of_the_published_vocabulary(word, expected):
    assert stem(word) == expected


def test_stems_of_folded_words_and_of_columns(spark):
    assert [stem(w) for w in ("travaux", "ecoles", "maintenance", "maintenances", "eaux", "", "x", "2019")] == ["traval", "ecol", "mainten", "mainten", "eau", "", "x", "2019"]
    df = spark.createDataFrame([(["ecoles", None, "ecole"],), ([],), (None,)], "m array<string>")
    assert [r[0] for r in df.select(stems(F.col("m"))).collect()] == [["ecol", None, "ecol"], [], None]


def test_trigrams(spark):
    r = spark.createDataFrame([("ab cd",), (None,), ("",)], "t string").select(trigrams(F.col("t"))).collect()
    assert r[0][0] == ["  a", " ab", "ab ", "  c", " cd", "cd "] and r[1][0] == [] and r[2][0] == []
