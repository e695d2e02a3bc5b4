"""Sentence boundaries across languages and scripts.

The rules are compiled into a finite transducer.  A lexer turns each text into its alphabet: line
breaks, opening and closing quotes of each kind, blanks between Thai letters, and for every mark that
may end a sentence what stands around it -- the kind of word before a full stop (an abbreviation, one
that only counts before a figure, a single letter, initials, a short number, any other word), before a
short number whether it begins its line or follows a word that goes with ordinals, and the kind of
character that follows.  Which of these combinations end a sentence, and whether one lies inside a
quotation, is the transducer's to say: its states are pairs of a quotation and of what was read of a mark.

Texts of a batch form one symbol sequence, cut into chunks of about ``CHUNK`` symbols between two marks:
each chunk becomes a function from state to state, the functions are composed by a parallel prefix
scan, and each chunk then emits its boundaries from its true start state.  The lexer reads a text once,
from its beginning to its end; a text is the work of one task, however long it is.

Rules: no sentence crosses a line break; a line, or the rest of one, without a final mark is one
unit; closing quotes and brackets belong to the sentence before; marks inside a quotation never cut;
after a closing quote the sentence ends if the quotation ended with a mark and a new one begins
(upper case; in scripts without case, unless the quotation opened the sentence); spaces between Thai
letters separate units, spaces beside figures do not.

Defined results: a null, empty or blank text gives no row; repeated rows give repeated results; text
that was decoded with the wrong charset is judged as the text it stands for, offsets being those of
the text as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ardoise.llm.mojibake import repair

CHUNK = 256

# Abbreviations that never end a sentence before a name or noun, by lower-case form.
NEVER_FINAL = frozenset(
    "m mm mme mmes mlle me mgr dr dre pr prof mr mrs ms st ste sr sra srta dra dn dña d cía cia ing lic hr fr frl hrn nr str vgl bzw ca z d u i s "
    "cf env réf ref vs approx i.e e.g z.b u.a d.h p.ej viz jr gen col lt sgt rev hon no n art fig p pp pág págs pag vol chap ch al tel tél "
    "डॉ श्री प्रो".split()
)
# Those of them that are also words of their own, so only a figure after them counts.
FIGURE_ONLY = frozenset("no art fig p pp pág págs pag vol chap ch n s".split())
# Words before a German ordinal number.
BEFORE_ORDINAL = frozenset("der die das dem den des am im vom zum zur beim bis ab ein eine einem einen einer jeder jede jedes seit".split())

_LONGEST_BEFORE_ORDINAL = max(map(len, BEFORE_ORDINAL))

MARKS = ".!?…。！？｡．؟۔।॥"
_BLANK = " \t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u202f\u205f\u3000\ufeff"
_LEX = re.compile("([\n\r])|([" + MARKS + "]+)|([«「『‹„“»”」』›\"])|(?<=[\u0e00-\u0e7f])([" + _BLANK + "]+)(?=[\u0e00-\u0e7f])")
_BESIDE_WORD = frozenset("()[]«»“”„\"'’/|")
_CLOSERS = ")]}’'"
_ONLY_CLOSERS = re.compile(r"[\s»”“\"」』›)\]}’']+$")

# Alphabet.
NL, THAI, G_ADJ, G_TXT, D_ADJ, D_TXT = range(6)
C_PLAIN, C_GO, C_UP, C_UNCASED = range(6, 10)
E_ADJ, E_TXT = 10, 14  # an English opening or German closing quote, plus one of four closings
Q_ADJ, Q_TXT, Q_SHUT = 18, 22, 26  # a straight quote, plus one of four closings
# Before a short number: it begins its line; it follows a word that goes with ordinals.
P_LINE, P_ORDINAL = 30, 31
# The word before a full stop; or a mark that needs none.
W_ABBREVIATION, W_FIGURE, W_LETTER, W_LETTER_ABBREVIATION, W_INITIALS, W_NUMBER, W_LOWER, W_OTHER, STRONG = range(32, 41)
# What follows a mark: the line ends; the sentence goes on; a figure after a blank; glued to the mark a capital, a letter
# without case, anything else; after a blank a capital, anything else (an opening quote or bracket needs no blank).
N_LINE_END, N_GOES_ON, N_FIGURE, N_GLUED_CAPITAL, N_GLUED_UNCASED, N_GLUED, N_CAPITAL, N_OTHER = range(41, 49)
IDLE = 49  # changes nothing
SYMBOLS = 50
# Quotations: outside one, at or after a sentence's start; inside one of each kind that opened the sentence or did not.
START, TEXT = 0, 1
IN_G, IN_D, IN_E, IN_Q = 2, 4, 6, 8
QUOTATIONS = 10
# What was read of a mark: nothing, what stands before a number, the word or mark, a number after either.
_READ = (None, P_LINE, P_ORDINAL, *range(W_ABBREVIATION, STRONG + 1), (P_LINE, W_NUMBER), (P_ORDINAL, W_NUMBER))
READS = len(_READ)
STATES = QUOTATIONS * READS


def _final(read: object, following: int) -> bool:
    """Whether a mark after what was read ends the sentence before what follows."""
    if following in (N_LINE_END, N_GOES_ON, N_GLUED):
        return following == N_LINE_END
    if read == STRONG:
        return True
    if following == N_GLUED_CAPITAL:
        return read == W_LOWER
    if following == N_GLUED_UNCASED:
        return read not in (W_ABBREVIATION, W_FIGURE, W_LETTER_ABBREVIATION)
    if following == N_FIGURE:
        return read not in (W_ABBREVIATION, W_FIGURE, W_LETTER, W_LETTER_ABBREVIATION)
    if read == (P_ORDINAL, W_NUMBER):
        return following != N_CAPITAL
    return read not in (W_ABBREVIATION, W_LETTER, W_LETTER_ABBREVIATION, W_INITIALS, (P_LINE, W_NUMBER))


def _quotations() -> tuple[np.ndarray, np.ndarray]:
    step = np.tile(np.arange(QUOTATIONS)[:, None], (1, SYMBOLS))
    emit = np.zeros((QUOTATIONS, SYMBOLS), bool)

    def close(state: int, symbol: int, how: int) -> None:
        opened_it = state >= 2 and state % 2 == 0
        ends = how == C_UP or how == C_UNCASED and not opened_it
        step[state, symbol], emit[state, symbol] = (START if ends else TEXT), ends

    closings = (C_PLAIN, C_GO, C_UP, C_UNCASED)
    for s in range(QUOTATIONS):
        step[s, NL], emit[s, NL] = START, True
        if s < 2:
            step[s, THAI], emit[s, THAI] = START, True
            for adj, txt, into in ((G_ADJ, G_TXT, IN_G), (D_ADJ, D_TXT, IN_D)):
                step[s, adj], step[s, txt] = (into if s == START else into + 1), into + 1
            for k, how in enumerate(closings):
                step[s, E_ADJ + k], step[s, E_TXT + k] = (IN_E if s == START else IN_E + 1), IN_E + 1
                step[s, Q_ADJ + k], step[s, Q_TXT + k] = (IN_Q if s == START else IN_Q + 1), IN_Q + 1
                step[s, Q_SHUT + k] = TEXT
                close(s, how, how)
        elif s < IN_Q:
            for k, how in enumerate(closings):
                close(s, how, how)
                if s in (IN_D, IN_D + 1):
                    close(s, E_ADJ + k, how)
                    close(s, E_TXT + k, how)
        else:
            for k, how in enumerate(closings):
                for first in (Q_ADJ, Q_TXT, Q_SHUT):
                    close(s, first + k, how)
    return step, emit


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """Steps and boundaries of every state; state = quotation * READS + what was read."""
    quote_step, quote_emit = _quotations()
    step, emit = np.zeros((STATES, SYMBOLS), np.int64), np.zeros((STATES, SYMBOLS), bool)
    for q in range(QUOTATIONS):
        for r, read in enumerate(_READ):
            for symbol in range(SYMBOLS):
                if symbol == IDLE:
                    to, ends = q * READS + r, False
                elif symbol < P_LINE:
                    to, ends = quote_step[q, symbol] * READS, quote_emit[q, symbol]
                elif symbol < N_LINE_END:
                    to, ends = q * READS + _READ.index((read, symbol) if (read, symbol) in _READ else symbol), False
                else:
                    ends = q < 2 and _final(read, symbol)
                    to = (q if q >= 2 else START if ends else TEXT) * READS
                step[q * READS + r, symbol], emit[q * READS + r, symbol] = to, ends
    return step, emit


STEP, EMIT = _compile()


def _word_start(t: str, s: int, seen: int, start: int) -> int:
    """Where the word that ends at s begins; if it goes back to ``seen``, that is ``start``.  Each character is looked at once."""
    k = s
    while k > seen and not t[k - 1].isspace() and t[k - 1] not in _BESIDE_WORD:
        k -= 1
    return start if k == seen else k


def _before(t: str, s: int) -> tuple[str, bool]:
    """The word before the blanks before s, and whether only blanks stand between s and the start of its line."""
    k = s
    while k and t[k - 1] in _BLANK:
        k -= 1
    e = k
    while k and (t[k - 1].isalnum() or t[k - 1] == "_") and e - k <= _LONGEST_BEFORE_ORDINAL:
        k -= 1
    return t[k:e], not e or t[e - 1] in "\n\r"


def _word(t: str, w: int, s: int) -> tuple[int, ...]:
    """Symbols of the word t[w:s] before a full stop."""
    word = t[w:s]
    low = word.lower()
    if len(word) == 1 and word.isalpha():
        return (W_LETTER_ABBREVIATION if low in NEVER_FINAL else W_LETTER,)
    if low in NEVER_FINAL:
        return (W_FIGURE if low in FIGURE_ONLY else W_ABBREVIATION,)
    if word.isdigit() and len(word) <= 2:
        before, first = _before(t, w)
        return (P_LINE, W_NUMBER) if first else (P_ORDINAL, W_NUMBER) if before.lower() in BEFORE_ORDINAL else (W_NUMBER,)
    if len(word) > 2 and word[-1].isupper() and word[-2] == "-" and word[-3] == ".":
        return (W_INITIALS,)
    return (W_LOWER,) if len(word) > 1 and word[-2:].islower() and "." not in word else (W_OTHER,)


def _following(t: str, i: int) -> int:
    """The symbol of what follows a mark and its closing brackets, which end at i."""
    j, n = i, len(t)
    while j < n and t[j] in _BLANK:
        j += 1
    if j >= n or t[j] in "\n\r":
        return N_LINE_END
    c = t[j]
    if c.islower() or c in ",;:":
        return N_GOES_ON
    if j == i and c.isalnum():
        if c.isupper():
            return N_GLUED_CAPITAL if j + 1 < n and t[j + 1].islower() else N_GLUED
        return N_GLUED_UNCASED if c.isalpha() else N_GLUED
    if j == i and c not in "«“„\"»”([¿¡「『":
        return N_GLUED
    return N_FIGURE if c.isdigit() else N_CAPITAL if c.isupper() else N_OTHER


def _closing(t: str, s: int, e: int) -> int:
    """What follows the closing quote t[s:e]: 0 no mark before it, 1 the sentence goes on, 2 a new one begins, 3 a letter without case."""
    b = s - 1
    while b >= 0 and t[b] in _BLANK:
        b -= 1
    if b < 0 or t[b] not in MARKS:
        return 0
    j, n = e, len(t)
    while j < n and t[j] in _BLANK:
        j += 1
    if j >= n or t[j] in "\n\r":
        return 1
    c = t[j]
    if c.islower() or c in ",;:、，；：–—-)" or c in MARKS or c in "とっ":
        return 1
    if c.isalpha() and not c.isupper() or c.isdigit() and t[s] in "”」』" and ord(t[b]) > 0x3000:
        return 3
    return 2


def _following_strong(t: str, i: int) -> int:
    """The same after a mark that needs no word: whatever does not go on begins anew, glued or not."""
    following = _following(t, i)
    return N_OTHER if following == N_GLUED else following


def lex(t: str) -> tuple[list[int], list[int]]:
    """Symbols of a text, and for each the place where the sentence ends if it is a boundary."""
    symbols, places, last = [], [], 0
    line_end, seen, word = -1, 0, 0
    for m in _LEX.finditer(t):
        s, e = m.span()
        k = m.lastindex
        if k == 2:
            i = e
            while i < len(t) and t[i] in _CLOSERS:
                i += 1
            if e - s > 1 or t[s] != ".":
                around = (STRONG, _following_strong(t, i))
            else:
                word, seen = _word_start(t, s, seen, word), s
                around = (*_word(t, word, s), _following(t, i))
            symbols += around
            places += [s] * (len(around) - 1) + [i]
            last = max(e, i)
        elif k == 1:
            symbols.append(NL)
            places.append(s)
            last = e
        elif k == 4:
            symbols.append(THAI)
            places.append(s)
            last = e
        else:
            c = t[s]
            text = 0 if not t[last:s].strip() else 1
            if c in "»”」』›":
                symbols.append(C_PLAIN + _closing(t, s, e))
            else:
                if line_end < s:
                    line_end = t.find("\n", s)
                    line_end = len(t) if line_end < 0 else line_end
                if c == '"':
                    shut = t.find('"', e, line_end) < 0
                    symbols.append((Q_SHUT if shut else Q_TXT if text else Q_ADJ) + _closing(t, s, e))
                elif c == "“":
                    symbols.append((E_TXT if text else E_ADJ) + _closing(t, s, e) if t.find("”", e, line_end) >= 0 or t.rfind("„", t.rfind("\n", 0, s) + 1, s) >= 0 else C_PLAIN)
                elif c == "„":
                    if t.find("“", e, line_end) < 0 and t.find("”", e, line_end) < 0:
                        continue
                    symbols.append(D_TXT if text else D_ADJ)
                else:
                    if t.find({"«": "»", "「": "」", "『": "』", "‹": "›"}[c], e, line_end) < 0:
                        continue
                    symbols.append(G_TXT if text else G_ADJ)
            places.append(e)
            last = e
    return symbols, places


def run(symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Which symbols are boundaries: chunk functions, composed by prefix scan, then each chunk from its true start."""
    n = len(symbols)
    if not n:
        return np.zeros(0, bool)
    # A chunk begins between two marks, where nothing of a mark was read: only quotations pass from one to the next.
    between = np.nonzero((symbols < P_LINE) | (symbols >= N_LINE_END) & (symbols != IDLE))[0] + 1
    starts = np.unique(np.concatenate([[0], between[np.searchsorted(between, np.arange(chunk, n, chunk)).clip(max=max(len(between) - 1, 0))] if len(between) else np.zeros(0, np.int64)]))
    starts = starts[starts < n]
    rows, sizes = len(starts), np.diff(np.append(starts, n))
    width = int(sizes.max())
    at = starts[:, None] + np.arange(width)
    inside = np.arange(width) < sizes[:, None]
    grid = np.where(inside, symbols[np.minimum(at, n - 1)], IDLE)
    f = np.tile(np.arange(QUOTATIONS) * READS, (rows, 1))
    for j in range(width):
        f = STEP[f, grid[:, j, None]]
    f //= READS
    step = 1
    while step < rows:  # f[i] becomes the composition of chunks 0..i
        f[step:] = np.take_along_axis(f[step:], f[:-step], axis=1)
        step *= 2
    state = np.concatenate([[START], f[:-1, START]]) * READS
    out = np.empty((rows, width), bool)
    for j in range(width):
        out[:, j] = EMIT[state, grid[:, j]]
        state = STEP[state, grid[:, j]]
    return out[inside]


def _units(t: str, cuts: list[int]) -> Iterator[tuple[int, int]]:
    a, held = 0, None
    for b in [*cuts, len(t)]:
        if b <= a:
            continue
        piece = t[a:b]
        body = piece.strip()
        if body:
            start = a + len(piece) - len(piece.lstrip())
            if held is not None and _ONLY_CLOSERS.match(body) and "\n" not in t[held[1] : start]:
                held = (held[0], start + len(body))
            else:
                if held is not None:
                    yield held
                held = (start, start + len(body))
        a = b
    if held is not None:
        yield held


def segment(texts: list[str | None]) -> list[list[tuple[int, int]]]:
    """Of each text, its sentences as (start, end) in code points."""
    fixed = [repair(t) if t else ("", None) for t in texts]
    lexed = [lex(t) for t, _ in fixed]
    # A line break before each text puts the transducer back to its start.
    flat = np.fromiter((s for symbols, _ in lexed for s in (NL, *symbols)), np.int64)
    cut = run(flat)
    out, at = [], 0
    for (t, places), (symbols, ends) in zip(fixed, lexed, strict=True):
        own = cut[at + 1 : at + 1 + len(symbols)]
        at += 1 + len(symbols)
        units = _units(t, [p for p, c in zip(ends, own, strict=True) if c])
        out.append([(places[a], places[b]) for a, b in units] if places else list(units))
    return out


def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = segment(batch.column(1).to_pylist())
        counts = np.fromiter((len(s) for s in spans), np.int64, len(spans))
        flat = np.array([p for s in spans for p in s], np.int32).reshape(-1, 2)
        ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(spans)), counts)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["doc_id", "debut", "fin"])


def sentences(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, debut, fin): every sentence of every document."""
    return documents.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(_segment_batches, "doc_id long, debut int, fin int")
