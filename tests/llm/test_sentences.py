import numpy as np
import pytest

from ardoise.llm import sentences as S


def cut(t):
    return [t[a:b] for a, b in S.segment([t])[0]]


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Martin arrive à 10 p.m. avec M. Durand.", "Quel retard !", "« Tout est prêt ? » a écrit Paul.", "Il paie 3,50 € H.T. et part."],
        ["It cost $7.95 vs. 17.7 before.", "The lab waited ... and left.", "“The board met. Did it help?” asked Ann.", "She wrote: “It works.”", "Version 5.16.4 runs on site.example today."],
        ["Am 13. Mai prüft Dr. Kurz den 2. Bericht, z. B. ohne Frist.", "„Wer prüft das?“, fragt Max.", "So nicht!"],
        ["¿Quién viene?", "«¿Quién entrega?», preguntó Ana.", "El Sr. Ruiz llegó, p. ej. tarde."],
        ["Menu | Home > Contact"],
        ["Voir p. 12, cf. art. 84.", "Et après…", "Rien."],
    ],
)
def test_latin_scripts(parts):
    assert cut(" ".join(parts)) == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["実験室が確認した。", "委員会は「見た。60日に延期した。」と述べた。", "「まだですか？」と聞いた。"],
        ["“旧地图在哪里？”港口办公室问了24次。", "实验室说：“推迟了报价单。”", "仓库送来了计划表！"],
        ["नक्शा कहाँ है?".replace("?", "।"), "डॉ. Martin ने देखा।".replace(" ।", "।")],
        ["قال د. Martin إن اللجنة وصلت.", "هل وصلت؟"],
    ],
)
def test_other_scripts(parts):
    assert cut(("" if ord(parts[0][0]) > 0x3000 or parts[0][0] == "“" else " ").join(parts)) == parts


def test_thai_spaces_separate_except_beside_figures():
    assert cut("ทีมสำรวจเดิน 54.9 กิโลเมตรแล้ว คณะกรรมการตรวจแล้ว") == ["ทีมสำรวจเดิน 54.9 กิโลเมตรแล้ว", "คณะกรรมการตรวจแล้ว"]


def test_lines_blanks_and_nothing():
    assert cut("  Titre\n\n\nUne phrase.  Fragment sans marque \n") == ["Titre", "Une phrase.", "Fragment sans marque"]
    assert S.segment([None, "", " \n\t"]) == [[], [], []]
    assert cut("1. Objet du texte\n 2. Suite. Fin.") == ["1. Objet du texte", "2. Suite.", "Fin."]
    assert cut("thaw.It cost 5. Yes.") == ["thaw.", "It cost 5.", "Yes."]


def test_wrong_charset_keeps_offsets_of_the_text_as_it_is():
    t = "La page demandée n'existe plus. Vérifiez l'adresse.".encode().decode("latin-1")
    assert cut(t) == ["La page demandÃ©e n'existe plus.", "VÃ©rifiez l'adresse."]


def test_composed_chunks_equal_one_sequential_run():
    r = np.random.default_rng(0)
    for n in (0, 1, 7, 255, 256, 257, 3000):
        symbols = r.integers(0, S.SYMBOLS, n)
        state, want = S.START, []
        for s in symbols:
            want.append(bool(S.EMIT[state, s]))
            state = S.STEP[state, s]
        for chunk in (1, 3, 256):
            assert S.run(symbols, chunk).tolist() == want


def test_very_long_text_and_frames(spark):
    t = "Une phrase courte. " * 50_000
    assert len(S.segment([t])[0]) == 50_000
    df = spark.createDataFrame([(1, "Ab. Cdef.", 0), (1, "Ab. Cdef.", 0), (None, "X.", 1), (3, None, 2)], "doc_id long, text string, debut int")
    got = sorted(map(tuple, S.sentences(df).collect()), key=str)
    assert got == sorted([(1, 0, 3), (1, 4, 9), (1, 0, 3), (1, 4, 9), (None, 0, 2)], key=str)
    assert S.sentences(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("read", "following", "ends"),
    [
        ((S.W_OTHER,), S.N_CAPITAL, True), ((S.W_OTHER,), S.N_GOES_ON, False), ((S.W_ABBREVIATION,), S.N_CAPITAL, False), ((S.W_ABBREVIATION,), S.N_LINE_END, True), ((S.W_FIGURE,), S.N_CAPITAL, True), ((S.W_FIGURE,), S.N_FIGURE, False),
        ((S.W_LETTER,), S.N_CAPITAL, False), ((S.W_INITIALS,), S.N_CAPITAL, False), ((S.P_LINE, S.W_NUMBER), S.N_CAPITAL, False), ((S.P_ORDINAL, S.W_NUMBER), S.N_CAPITAL, False), ((S.P_ORDINAL, S.W_NUMBER), S.N_OTHER, True),
        ((S.W_NUMBER,), S.N_CAPITAL, True), ((S.W_LOWER,), S.N_GLUED_CAPITAL, True), ((S.W_OTHER,), S.N_GLUED_CAPITAL, False), ((S.W_OTHER,), S.N_GLUED, False), ((S.STRONG,), S.N_GOES_ON, False), ((S.STRONG,), S.N_OTHER, True),
    ],
)
def test_marks_are_decided_by_the_transducer(read, following, ends):
    assert S.run(np.array([*read, following])).tolist() == [False] * len(read) + [ends]
    # Inside a quotation no mark cuts.
    assert not S.run(np.array([S.G_ADJ, *read, following])).any()


def test_words_of_any_length_before_a_mark():
    long = "www." + "a" * 5000 + ".Example"
    assert cut(f"Voir {long} ici. Fin.") == [f"Voir {long} ici.", "Fin."]
    assert cut(" " * 60 + "3. Objet. Fin.") == ["3. Objet.", "Fin."]
    assert cut("Am" + " " * 60 + "13. Mai. So.") == ["Am" + " " * 60 + "13. Mai.", "So."]
