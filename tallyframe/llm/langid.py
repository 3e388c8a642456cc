"""Language of a text by its script and its function words."""

from __future__ import annotations

import re
from collections import Counter

#: Function words that mark one language among those listed (fixed values).
FUNCTION_WORDS = {
    "en": "the and of to were with that which this from not have has had been should must before after are it its for when while whose what why how by they is on be or",
    "de": "der die das und ist wurde wurden den dem des nicht auf eine einen einer ein von zu mit sich für wird werden weil bevor nachdem waren bei wenn noch dass zum zur auch kann wie ich dazu bitte keine unter über sind war aber lautet",
    "fr": "le la les des et est une dans pour ont été que qui pas sur ne du au aux ce cette par plus avec sont avant après pourquoi quels quelles lorsque je nous mais car elle deux sous restaient fois",
    "es": "el los las una por con para fue fueron qué cómo del se que y al lo su sin más este esta cuando antes después porque hasta pero como hay mientras seguían veces dos según sobre",
    "it": "il gli della dei delle di che è sono stato stati stata non una per con nel alla dopo prima perché ma come più anche questo poi senza mentre ogni fino bisogna vengano",
    "nl": "het een van dat niet zijn voor moet wordt werd werden alle met aan door naar maar ook bij eerst zonder waarom daarna dit heeft omdat nog opnieuw blijft terwijl voordat",
    "pt": "os uma não foi dos das pelo ao são mais também até mas ele ela isso foram em na no à depois antes porque quando sem",
    "sv": "och att det som är inte på av ett har för till efter innan men också",
    "pl": "nie jest się że na jak ale był są przez po przed tylko oraz dla",
}
_TABLE: dict[str, tuple[str, ...]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _TABLE[_w] = (*_TABLE.get(_w, ()), _lang)
_WORD = re.compile(r"[^\W\d_]+")
_GAPS = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalpha()})


def letters(low: str) -> list[str]:
    """The runs of letters of a text in lower case."""
    return low.translate(_GAPS).split() if low.isascii() else _WORD.findall(low)


#: Scripts that tell the language or its family: ranges of code points (fixed values).
_SCRIPTS = [
    ("ja", re.compile(r"[぀-ヿ]")),
    ("ko", re.compile(r"[가-힯]")),
    ("zh", re.compile(r"[一-鿿]")),
    ("ru", re.compile(r"[Ѐ-ӿ]")),
    ("ar", re.compile(r"[؀-ۿ]")),
    ("el", re.compile(r"[Ͱ-Ͽ]")),
    ("he", re.compile(r"[֐-׿]")),
    ("th", re.compile(r"[฀-๿]")),
    ("hi", re.compile(r"[ऀ-ॿ]")),
]
_ANY_SCRIPT = re.compile("[" + "".join(p.pattern[1:-1] for _, p in _SCRIPTS) + "]")


def language_scores(text: str) -> dict[str, float]:
    """Marks per language; a word of several languages counts for each in part."""
    scores: dict[str, float] = {}
    if not text.isascii() and _ANY_SCRIPT.search(text):
        for lang, pattern in _SCRIPTS:
            n = len(pattern.findall(text))
            if n and (lang != "zh" or "ja" not in scores):
                scores[lang] = n / 2
            elif n:
                scores["ja"] += n / 2
    for langs, n in Counter(map(_TABLE.get, letters(text.lower()))).items():
        for x in langs or ():
            scores[x] = scores.get(x, 0.0) + n / len(langs)
    return scores


def language(text: str | None) -> str | None:
    """The language with most marks, or None if there is no mark or the first two are level."""
    if not text:
        return None
    s = sorted(language_scores(text).items(), key=lambda kv: (-kv[1], kv[0]))
    if not s or len(s) > 1 and s[0][1] == s[1][1]:
        return None
    return s[0][0]
