"""The published Snowball stemmer for French, and text normalisation with it."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

VOWELS = "aeiouyâàëéêèïîôûù"

# Fixed values of the algorithm: suffixes by step.
PLAIN = "ances iqUes ismes ables istes ance iqUe isme able iste eux".split()
ATION = "atrices ateurs ations atrice ateur ation".split()
I_VERB = "issaIent issantes iraIent issante issants issions irions issais issait issant issent issiez issons irais irait irent iriez irons iront isses issez îmes îtes irai iras irez isse ies ira ît ie ir is it i".split()
E_VERB = "eraIent erions èrent erais erait eriez erons eront erai eras erez ées era iez ée és er ez é".split()
A_VERB = "assions assent assiez aIent antes asses âmes âtes ante ants asse ais ait ant ât ai as a".split()
#: What is written one way of several, in the order it is looked for.
SYNONYMS = {
    "fonds de commerce": "fonds commercial",
    "leasing": "credit-bail",
    "location avec option d'achat": "credit-bail",
    "ifc": "indemnites de fin de carriere",
    "indemnite de depart a la retraite": "indemnites de fin de carriere",
    "actif incorporel": "immobilisation incorporelle",
    "actif corporel": "immobilisation corporelle",
    "stock-options": "options de souscription ou d'achat d'actions",
    "goodwill": "fonds commercial",
}


def _marked(word: str) -> str:
    """Vowels that act as consonants in upper case."""
    out = list(word)
    for k, c in enumerate(word):
        before = out[k - 1] if k else ""
        after = word[k + 1] if k + 1 < len(word) else ""
        around = before and before in VOWELS and after and after in VOWELS
        if c == "u" and (before == "q" or around) or c == "i" and around or c == "y" and (before and before in VOWELS or after and after in VOWELS):
            out[k] = c.upper()
    return "".join(out)


def _after_vowel_consonant(word: str, start: int) -> int:
    found = re.compile(f"[{VOWELS}][^{VOWELS}]").search(word, start)
    return found.end() if found else len(word)


def _verb_region(word: str) -> int:
    if word[:2] and all(c in VOWELS for c in word[:2]) and len(word) > 2 or word[:3] in ("par", "col", "tap"):
        return 3
    found = re.compile(f"[{VOWELS}]").search(word, 1)
    return found.end() if found else len(word)


class _Word:
    def __init__(self, word: str) -> None:
        self.w = _marked(word)
        self.rv = _verb_region(self.w)
        self.r1 = _after_vowel_consonant(self.w, 0)
        self.r2 = _after_vowel_consonant(self.w, self.r1)

    def ends(self, *suffixes: str, region: int = 0) -> str | None:
        return next((s for s in sorted(suffixes, key=len, reverse=True) if self.w.endswith(s) and len(self.w) - len(s) >= region), None)

    def put(self, suffix: str, new: str = "") -> bool:
        self.w = self.w[: len(self.w) - len(suffix)] + new
        return True

    def drop_in(self, suffix: str, region: int) -> bool:
        return len(self.w) - len(suffix) >= region and self.w.endswith(suffix) and self.put(suffix)

    def vowel_before(self, suffix: str, region: int = 0) -> bool:
        at = len(self.w) - len(suffix) - 1
        return at >= region and self.w[at] in VOWELS

    def ic(self) -> None:
        if self.w.endswith("ic") and not self.drop_in("ic", self.r2):
            self.put("ic", "iqU")


ENDINGS = [*PLAIN, *ATION, "logies", "logie", "usions", "utions", "usion", "ution", "ences", "ence", "issements", "issement", "ements", "ement", "ités", "ité", "ives", "ifs", "ive", "if", "eaux", "aux", "euses", "euse", "amment", "emment", "ments", "ment"]


def _standard(x: _Word) -> bool:
    """Step 1; whether the ending it found was taken away (so that verbs aren't tried)."""
    s = x.ends(*ENDINGS)
    if s is None:
        return False
    in_r2, in_r1, in_rv = (len(x.w) - len(s) >= r for r in (x.r2, x.r1, x.rv))
    if s in PLAIN:
        return in_r2 and x.put(s)
    if s in ATION:
        if in_r2:
            x.put(s)
            x.ic()
        return in_r2
    if s.startswith("logie"):
        return in_r2 and x.put(s, "log")
    if s.startswith(("usion", "ution")):
        return in_r2 and x.put(s, "u")
    if s.startswith("ence"):
        return in_r2 and x.put(s, "ent")
    if s.startswith("issement"):
        return in_r1 and not x.vowel_before(s) and x.put(s)
    if s in ("ement", "ements"):
        if not in_rv:
            return False
        x.put(s)
        if x.w.endswith("iv"):
            if x.drop_in("iv", x.r2):
                x.drop_in("at", x.r2)
        elif x.w.endswith("eus"):
            if not x.drop_in("eus", x.r2) and len(x.w) - 3 >= x.r1:
                x.put("eus", "eux")
        elif t := x.ends("abl", "iqU"):
            x.drop_in(t, x.r2)
        elif (t := x.ends("ièr", "Ièr")) and len(x.w) - 3 >= x.rv:
            x.put(t, "i")
        return True
    if s.startswith("ité"):
        if in_r2:
            x.put(s)
            if x.w.endswith("abil"):
                if not x.drop_in("abil", x.r2):
                    x.put("abil", "abl")
            elif x.w.endswith("ic"):
                x.ic()
            else:
                x.drop_in("iv", x.r2)
        return in_r2
    if s in ("if", "ive", "ifs", "ives"):
        if in_r2:
            x.put(s)
            if x.drop_in("at", x.r2):
                x.ic()
        return in_r2
    if s == "eaux":
        return x.put(s, "eau")
    if s == "aux":
        return in_r1 and x.put(s, "al")
    if s.startswith("euse"):
        return in_r2 and x.put(s) or in_r1 and x.put(s, "eux")
    # Adverbs change the word, and verbs are tried all the same.
    if s in ("amment", "emment") and in_rv:
        x.put(s, "ant" if s[0] == "a" else "ent")
    elif s in ("ment", "ments") and x.vowel_before(s, x.rv):
        x.put(s)
    return False


def _verb(x: _Word) -> bool:
    """Step 2: endings of verbs in i, then of the others."""
    s = x.ends(*I_VERB, region=x.rv)
    if s and len(x.w) - len(s) > x.rv and not x.vowel_before(s, x.rv):
        return x.put(s)
    s = x.ends("ions", *E_VERB, *A_VERB, region=x.rv)
    if s == "ions":
        return x.drop_in(s, x.r2)
    if s:
        x.put(s)
        if s in A_VERB and x.w.endswith("e") and len(x.w) - 1 >= x.rv:
            x.put("e")
    return bool(s)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case French word."""
    x = _Word(word)
    before = x.w
    if _standard(x) or _verb(x) or x.w != before:
        x.w = x.w[:-1] + {"Y": "i", "ç": "c"}.get(x.w[-1:], x.w[-1:])
    else:
        if re.search("[^aiouès]s$", x.w):
            x.put("s")
        if len(x.w) - 3 >= x.r2 and re.search("[st]ion$", x.w) and len(x.w) - 4 >= x.rv:
            x.put("ion")
        elif t := x.ends("ier", "ière", "Ier", "Ière", region=x.rv):
            x.put(t, "i")
        elif x.w.endswith("e") and len(x.w) - 1 >= x.rv:
            x.put("e")
    if x.ends("enn", "onn", "ett", "ell", "eill"):
        x.w = x.w[:-1]
    x.w = re.sub(f"[éè]([^{VOWELS}]+)$", r"e\1", x.w)
    return x.w.lower()


def folded(text: str) -> str:
    """Accents dropped."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def normalized(text: str | None) -> str:
    """Lower case, straight apostrophes, no elisions, references glued, synonyms made one, words stemmed and folded."""
    text = re.sub("[’‘ʼ]", "'", (text or "").lower())
    text = re.sub(r"\b(?:jusqu|lorsqu|puisqu|quoiqu|presqu|aujourd|qu|[ldjmnstc])'", "", text)
    text = re.sub(r"\b([lrd])\.?\s*(\d{1,4}(?:-\d+)+)\b", r"\1\2", text)
    for found, canonical in SYNONYMS.items():
        # Looked for without accents, replaced in the text itself: both have the same length.
        plain = "".join(folded(c)[:1] or c for c in text)
        kept, last = [], 0
        for m in re.finditer(re.escape(found), plain):
            kept += [text[last : m.start()], canonical]
            last = m.end()
        text = "".join([*kept, text[last:]])
    words = (w for w in re.split("[^a-z0-9à-ÿ-]+", text) if w not in ("", "-"))
    return " ".join(w.strip("-") if re.search(r"\d", w) else folded(stem(w)) for w in words)


def normalize(column):
    """``normalized`` as an Arrow UDF."""

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(normalized)

    return made(column)
