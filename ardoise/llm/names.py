"""Reading names of public bodies, firms and persons: words, kind of body, legal form, details."""

from __future__ import annotations

import re
import unicodedata

# Kinds of French public bodies, each with the sets of words that name it; those with a
# singular or noun in place of the usual word are what a misspelling is resolved to.
KINDS = {
    "commune": ["commune", "mairie", "ville", "cne", "municipalite"],
    "communaute de communes": ["communaute communes", "communaute commune", "com com", "cc", "cdc", "comcom", "codecom"],
    "communaute d'agglomeration": ["communaute agglomeration", "com agglo", "agglo"],
    "communaute urbaine": ["communaute urbaine"],
    "metropole": ["metropole"],
    "departement": ["departement", "conseil departemental", "conseil general"],
    "region": ["region", "conseil regional"],
    "ccas": ["centre communal action sociale", "ctre communal action sociale", "centre commune action sociale", "ctre commune action sociale", "ccas"],
    "cias": ["centre intercommunal action sociale", "cias"],
    "office de l'habitat": ["office public habitat", "off public habitat", "office habitat", "oph", "opac", "habitat"],
    "centre hospitalier": ["centre hospitalier", "ctre hospitalier", "ch", "hopital"],
    "chu": ["centre hospitalier universitaire", "chu", "chru"],
    "lycee professionnel": ["lycee professionnel", "lycee pro", "lp"],
    "lycee": ["lycee"],
    "college": ["college", "clg"],
    "universite": ["universite", "univ"],
    "syndicat des eaux": ["syndicat intercommunal eaux", "synd interc eaux", "syndicat eaux", "synd eaux", "sie", "siaep", "syndicat interc eaux", "synd intercommunal eaux"],
    "sdis": ["service departemental incendie secours", "sdis"],
    "ehpad": ["ehpad", "maison retraite"],
}
# Legal forms.
LEGAL = frozenset("sarl sas sasu sa eurl scop scic sci snc scp selarl selas gie earl scea ei eirl".split())
# Words that say nothing about who it is.
EMPTY = frozenset("de d du des la le les l et en sur sous au aux a ou mme mr mlle monsieur madame ste societe soc ets etablissements etablissement entreprise cie compagnie groupe".split())
# Nicknames and short forms that are not simply the first letters of the word.
SHORT = {"resto": "restauration", "gaby": "gabrielle", "jo": "josephine", "bob": "robert", "bill": "guillaume", "manu": "emmanuel", "seb": "sebastien", "nico": "nicolas", "fred": "frederic", "dom": "dominique", "domi": "dominique", "titi": "thierry", "jojo": "georges", "mimi": "michele", "trvx": "travaux", "batiment": "batiment", "bat": "batiment", "elec": "electricite", "nett": "nettoyage", "transp": "transports"}

KIND_WORDS = frozenset(w for sets in KINDS.values() for s in sets for w in s.split())
LEXICON = KIND_WORDS | LEGAL | EMPTY | frozenset(SHORT.values())
_PATTERNS = sorted(((frozenset(s.split()), tuple(s.split()), kind) for kind, sets in KINDS.items() for s in sets), key=lambda p: -len(p[1]))
_WORD = re.compile(r"[a-z0-9]+")


def words(name: str | None) -> list[str]:
    """Folded words of a name; letters with full stops between them (C.C.A.S.) become one word."""
    if not name:
        return []
    s = name.casefold()
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    if "." not in s:
        return _WORD.findall(s)
    out: list[str] = []
    run = False
    for m in _WORD.finditer(s):
        w = m[0]
        dotted = len(w) == 1 and s[m.end() : m.end() + 1] == "." and s[m.end() + 1 : m.end() + 2].isalnum()
        if run and len(w) == 1:
            out[-1] += w
        else:
            out.append(w)
        run = dotted
    return out


def joins(ws: list[str]) -> list[str]:
    """Neighbouring words run together: what they were if a space was typed inside a word."""
    return [a + b for a, b in zip(ws, ws[1:])]


def read(ws: list[str]) -> tuple[str, str, list[str]]:
    """(kind, legal form, remaining words) of canonical words, whatever their order."""
    ws = [SHORT.get(w, w) for w in ws]
    have = set(ws)
    kind = ""
    if "mme" in have or "madame" in have:
        ws = [w for w in ws if w != "m"]
    for need, order, k in _PATTERNS:
        if need <= have and (order[0] != "com" or ws.count("com") >= 2):
            kind = k
            ws = [w for w in ws if w not in need]
            break
    legal = next((w for w in ws if w in LEGAL), "")
    return kind, legal, [w for w in ws if w not in LEGAL and w not in EMPTY]


def covers(short: frozenset[str], full: frozenset[str]) -> bool:
    """Whether the words of ``short`` all stand for words of ``full``: equal, its first letters, or initials of several."""
    for w in short:
        if w in full or any(f.startswith(w) for f in full):
            continue
        initials = sorted(f[0] for f in full)
        if 2 <= len(w) <= 4 and all(initials.count(c) >= w.count(c) for c in w):
            continue
        return False
    return True
