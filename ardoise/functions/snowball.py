"""The French stemmer of the Snowball family, after its published description, over Arrow columns.

A word is lower case; accents may have been folded before.  Every distinct word of a batch is stemmed
once, however often it occurs.

Defined results: null stays null, the empty word stays empty; words of other scripts come out as they are.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Vowels, and the endings of each step of the published algorithm.
VOWELS = "aeiouyâàëéêèïîôûù"
ENDINGS = {
    "drop": "ance iqUe isme able iste eux ances iqUes ismes ables istes",
    "ation": "atrice ateur ation atrices ateurs ations",
    "logie": "logie logies",
    "usion": "usion ution usions utions",
    "ence": "ence ences",
    "ement": "ement ements",
    "ite": "ité ités",
    "if": "if ive ifs ives",
    "eaux": "eaux",
    "aux": "aux",
    "euse": "euse euses",
    "issement": "issement issements",
    "amment": "amment",
    "emment": "emment",
    "ment": "ment ments",
}
I_VERB = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it"
E_VERB = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"
A_VERB = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"
REGION_STARTS = ("par", "col", "tap")


def _longest_first(words: str) -> list[str]:
    return sorted(words.split(), key=len, reverse=True)


_KIND = {e: kind for kind, words in ENDINGS.items() for e in words.split()}
_STANDARD, _I, _E_AND_A = _longest_first(" ".join(_KIND)), _longest_first(I_VERB), _longest_first(f"{E_VERB} {A_VERB} ions")
_E_SET = frozenset(E_VERB.split())
_AFTER = re.compile(f"[{VOWELS}][^{VOWELS}]")


class _Word:
    """A word with its regions; an ending lies in a region if it begins in it."""

    def __init__(self, w: str):
        w = re.sub("qu", "qU", w)
        w = re.sub(f"(?<=[{VOWELS}])([ui])(?=[{VOWELS}])", lambda m: m[1].upper(), w)
        self.text = re.sub(f"y(?=[{VOWELS}])|(?<=[{VOWELS}])y", "Y", w)
        w = self.text
        if w[:3] in REGION_STARTS or len(w) > 2 and w[0] in VOWELS and w[1] in VOWELS:
            self.rv = 3
        else:
            self.rv = next((k + 1 for k in range(1, len(w)) if w[k] in VOWELS), len(w))
        self.r1 = self._after(0)
        self.r2 = self._after(self.r1)

    def _after(self, start: int) -> int:
        m = _AFTER.search(self.text, start)
        return m.end() if m else len(self.text)

    def ends(self, ending: str, region: int = 0) -> bool:
        return self.text.endswith(ending) and len(self.text) - len(ending) >= region

    def cut(self, ending: str, instead: str = "") -> None:
        self.text = self.text[: len(self.text) - len(ending)] + instead

    def cut_if(self, ending: str, region: int, instead: str | None = None, other: int | None = None) -> bool:
        """Drops an ending that lies in the region, or else puts ``instead`` (if it lies in ``other``); whether it changed."""
        if not self.text.endswith(ending):
            return False
        if self.ends(ending, region):
            self.cut(ending)
        elif instead is not None and (other is None or self.ends(ending, other)):
            self.cut(ending, instead)
        else:
            return False
        return True


def _standard(w: _Word) -> bool:
    """The standard endings; whether one was taken off."""
    ending = next((e for e in _STANDARD if w.text.endswith(e)), None)
    if ending is None:
        return False
    kind = _KIND[ending]
    if kind == "drop":
        return w.cut_if(ending, w.r2)
    if kind == "ation":
        done = w.cut_if(ending, w.r2)
        if done:
            w.cut_if("ic", w.r2, "iqU")
        return done
    if kind in ("logie", "usion", "ence"):
        if w.ends(ending, w.r2):
            w.cut(ending, {"logie": "log", "usion": "u", "ence": "ent"}[kind])
            return True
        return False
    if kind == "ement":
        done = w.cut_if(ending, w.rv)
        if done:
            if w.ends("iv"):
                if w.cut_if("iv", w.r2):
                    w.cut_if("at", w.r2)
            elif w.ends("eus"):
                w.cut_if("eus", w.r2, "eux", w.r1)
            elif w.ends("abl") or w.ends("iqU"):
                w.cut_if(w.text[-3:], w.r2)
            elif w.ends("ièr", w.rv) or w.ends("Ièr", w.rv):
                w.cut(w.text[-3:], "i")
        return done
    if kind == "ite":
        done = w.cut_if(ending, w.r2)
        if done:
            if w.ends("abil"):
                w.cut_if("abil", w.r2, "abl")
            elif w.ends("ic"):
                w.cut_if("ic", w.r2, "iqU")
            else:
                w.cut_if("iv", w.r2)
        return done
    if kind == "if":
        done = w.cut_if(ending, w.r2)
        if done and w.cut_if("at", w.r2):
            w.cut_if("ic", w.r2, "iqU")
        return done
    if kind == "eaux":
        w.cut(ending, "eau")
        return True
    if kind == "aux":
        if w.ends(ending, w.r1):
            w.cut(ending, "al")
            return True
        return False
    if kind == "euse":
        return w.cut_if(ending, w.r2, "eux", w.r1)
    if kind == "issement":
        before = w.text[: len(w.text) - len(ending)]
        if w.ends(ending, w.r1) and before and before[-1] not in VOWELS:
            w.cut(ending)
            return True
        return False
    if kind in ("amment", "emment"):
        if w.ends(ending, w.rv):
            w.cut(ending, kind[0] + "nt")
        return False
    before = len(w.text) - len(ending) - 1
    if before >= w.rv and w.text[before] in VOWELS:
        w.cut(ending)
    return False


def _verb_i(w: _Word) -> bool:
    ending = next((e for e in _I if w.ends(e, w.rv)), None)
    if ending is None:
        return False
    before = len(w.text) - len(ending) - 1
    if before < w.rv or w.text[before] in VOWELS:
        return False
    w.cut(ending)
    return True


def _verb(w: _Word) -> bool:
    ending = next((e for e in _E_AND_A if w.ends(e, w.rv)), None)
    if ending is None:
        return False
    if ending == "ions":
        return w.cut_if(ending, w.r2)
    w.cut(ending)
    if ending not in _E_SET and w.ends("e", w.rv):
        w.cut("e")
    return True


def _residual(w: _Word) -> None:
    if len(w.text) > 1 and w.text[-1] == "s" and w.text[-2] not in "aiouès":
        w.cut("s")
    if w.ends("ion", w.r2) and len(w.text) - 4 >= w.rv and w.text[-4] in "st":
        w.cut("ion")
        return
    for ending, instead in (("ier", "i"), ("ière", "i"), ("Ier", "i"), ("Ière", "i"), ("e", "")):
        if w.ends(ending, w.rv):
            w.cut(ending, instead)
            return
    if w.ends("guë", w.rv):
        w.cut("ë")


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of one lower-case word."""
    w = _Word(word)
    before = w.text
    taken = _standard(w)
    special = not taken
    changed = taken or w.text != before
    if special:
        changed = _verb_i(w) or _verb(w) or w.text != before
    if changed:
        if w.text.endswith("Y"):
            w.cut("Y", "i")
        elif w.text.endswith("ç"):
            w.cut("ç", "c")
    else:
        _residual(w)
    for double in ("enn", "onn", "ett", "ell", "eill"):
        if w.text.endswith(double):
            w.text = w.text[:-1]
            break
    m = re.search(f"[éè]([^{VOWELS}]+)$", w.text)
    if m:
        w.text = w.text[: m.start()] + "e" + m[1]
    return w.text.lower()


def _stems(words: pa.Array) -> pa.Array:
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    flat = words.flatten().cast(pa.string()).dictionary_encode()
    stems = pa.array([None if w is None else stem(w) for w in flat.dictionary.to_pylist()], pa.string()).take(flat.indices)
    lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = pa.array([0, *lengths.cumsum().tolist()], pa.int32())
    return pa.ListArray.from_arrays(offsets, stems, mask=words.is_null() if words.null_count else None)


def stems(words: Column) -> Column:
    """The stems of an array of words, in order."""
    return F.arrow_udf(_stems, "array<string>")(words)
