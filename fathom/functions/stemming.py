"""Stemmers and phonetic codes, as plain functions of one term."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

VOWELS = "aeiou"


def _cons(w: str, i: int) -> bool:
    c = w[i]
    return c not in VOWELS and not (c == "y" and i > 0 and _cons(w, i - 1))


def _measure(w: str) -> int:
    kinds = "".join("c" if _cons(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _has_vowel(w: str) -> bool:
    return any(not _cons(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _cons(w, len(w) - 1) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 3) and w[-1] not in "wxy"


#: The endings of steps 2 to 4 of Porter's description.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]


@lru_cache(maxsize=1 << 16)
def porter(w: str) -> str:
    """Porter's algorithm of 1980, with the two later additions of its author (bli, logi)."""
    if len(w) < 3:
        return w
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + to
            break
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        for end, to in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + to
                break
    for end in STEP4:
        if w.endswith(end):
            rest = w[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest[-1:] in ("s", "t")):
                w = rest
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if _measure(w) > 1 and _double(w) and w[-1] == "l":
        w = w[:-1]
    return w


def possessive(w: str) -> str:
    return w[:-2] if len(w) > 2 and w[-1] in "sS" and w[-2] in "'’＇" else w


def english_minimal(w: str) -> str:
    """Harman's S stemmer."""
    if len(w) < 3 or w[-1] != "s" or w[-2] in "us":
        return w
    if w[-2] == "e":
        if len(w) > 3 and w[-3] == "i" and w[-4] not in "ae":
            return w[:-3] + "y"
        if w[-3] in "iaoe":
            return w
    return w[:-1]


def spanish_plural(w: str) -> str:
    """Plural to singular: -ces, -es after consonants, -s after vowels."""
    if len(w) < 4 or not w.endswith("s"):
        return w
    if w.endswith("ces"):
        return w[:-3] + "z"
    if w.endswith("es") and w[-3] not in "aeiouáéíóú":
        return w[:-2]
    return w[:-1] if w[-2] in "aeiouáéó" else w


def _plain(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


def _suffixes(least: int, *ends: str) -> Callable[[str], str]:
    """A light stemmer: the longest suffix that leaves `least` letters goes; accents go with it."""
    longest = sorted(ends, key=len, reverse=True)

    def stem(w: str) -> str:
        w = _plain(w)
        return next((w[: -len(e)] for e in longest if w.endswith(e) and len(w) - len(e) >= least), w)

    return stem


def _rules(w: str, rules: list[tuple[int, str, str]]) -> str:
    """The first rule (letters that the word has at least, end, what stands for it) that fits."""
    return next((w[: len(w) - len(end)] + to for least, end, to in rules if len(w) >= least and w.endswith(end)), w)


def german_light(w: str) -> str:
    """Plurals and cases, then comparatives: two rounds of the endings that nouns and adjectives take."""
    w = w.translate(str.maketrans("äàáâöòóôïìíîüùúû", "aaaaooooiiiiuuuu"))
    after = lambda w, k: len(w) > k and w[-k - 1] in "bdfghklmnt"
    w = _rules(w, [(6, "ern", ""), (5, "em", ""), (5, "en", ""), (5, "er", ""), (5, "es", ""), (4, "e", ""), *([(4, "s", "")] if after(w, 1) else [])])
    return _rules(w, [(6, "est", ""), (5, "er", ""), (5, "en", ""), *([(5, "st", "")] if after(w, 2) else [])])


def spanish_light(w: str) -> str:
    """Plurals, and the vowel of gender."""
    if len(w) < 5:
        return w
    w = _plain(w.replace("ñ", "\x00")).replace("\x00", "ñ")
    return _rules(w, [(5, "eses", "es"), (5, "ces", "z"), (5, "os", ""), (5, "as", ""), (5, "es", ""), (5, "o", ""), (5, "a", ""), (5, "e", "")])


def italian_light(w: str) -> str:
    """The final vowel, with the i or h before it."""
    if len(w) < 6:
        return w
    w = _plain(w)
    return _rules(w, [(6, x + v, "") for v, befores in (("e", "ih"), ("i", "ih"), ("a", "i"), ("o", "i")) for x in befores] + [(6, v, "") for v in "eiao"])


def portuguese_light(w: str) -> str:
    """Plurals and adverbs, then feminines, then the final vowel; accents go last."""
    if len(w) < 4:
        return w
    plural = [(5, c + "es", c) for c in "rslz"] + [(4, "ns", "m"), (5, "eis", "el"), (5, "éis", "el"), (5, "ais", "al"), (5, "óis", "ol"), (5, "is", "il"), (4, "ões", "ão"), (4, "ães", "ão"), (7, "mente", ""), (4, "s", "")]
    w = _rules(w, plural)
    if len(w) > 3 and w.endswith("a"):
        long = [(8, e + "a", e + "o") for e in ("inh", "iac", "eir")]
        short = [(7, e + "a", e + "o") for e in ("os", "ic", "id", "ad", "iv", "am")]
        w = _rules(w, [*long, *short, (7, "ona", "ão"), (7, "ora", "or"), (7, "esa", "ês"), (7, "na", "no")])
    if len(w) > 4 and w[-1] in "eao":
        w = w[:-1]
    return _plain(w)


#: Light stemmers of language analyzers; the French one is a list of suffixes that comes near to its language's.
LIGHT: dict[str, Callable[[str], str]] = {
    "french": _suffixes(3, "issements", "issement", "atrices", "atrice", "ateurs", "ateur", "ations", "ation", "ements", "ement", "euses", "euse", "ences", "ence", "ances", "ance", "ites", "ite", "ives", "ive", "ifs", "if", "aux", "eux", "ees", "ee", "es", "er", "ir", "e", "s", "x"),
    "german": german_light, "italian": italian_light, "portuguese": portuguese_light, "spanish": spanish_light,
}

DM_RULES = None


def _dm_table() -> list[tuple[str, list[str], list[str], list[str]]]:
    """Fixed values, the published table of Daitch and Mokotoff: pattern and its codes at the start, before a vowel, elsewhere ('' is not coded; a second entry branches)."""
    raw = """ai aj ay|0|1|; au|0|7|; a|0||; ei ej ey|0|1|; eu|1|1|; e|0||; ia ie io iu|1||; i|0||; oi oj oy|0|1|; o|0||; ui uj uy|0|1|; ue|0||; u|0||;
    schtsch schtsh schtch|2|4|4; shtch shch shtsh|2|4|4; stsch stch strz strs stsh|2|4|4; ttsch ttch ttsz|4|4|4; tsch tch tsh ttz ttszs|4|4|4; szcz szcs|2|4|4; zhdzh zdzh zdz|2|4|4;
    sch|4|4|4; sht scht schd|2|43|43; szt shd szd sd st|2|43|43; zsch zsh zh zs|4|4|4; drz drs ds dsh dsz dz dzh dzs dt d|DZ; csz czs cs cz|4|4|4; trz trs th t ts tts ttss tc tz tzs tsz|TZ;
    b|7|7|7; chs|5|54|54; ch|5/4|5/4|5/4; ck|5/45|5/45|5/45; c|5/4|5/4|5/4; fb|7|7|7; f|7|7|7; g|5|5|5; h|5|5|; j|1/4|/4|/4; ks|5|54|54; kh|5|5|5; k|5|5|5; l|8|8|8; mn|66|66|66; m|6|6|6; nm|66|66|66; n|6|6|6;
    pf ph|7|7|7; p|7|7|7; q|5|5|5; rs rz|4/94|4/94|4/94; r|9|9|9; sh|4|4|4; sz s|4|4|4; v|7|7|7; w|7|7|7; x|5|54|54; y|1||; zd|2|43|43; z|4|4|4"""
    table = []
    for rule in raw.split(";"):
        names, _, codes = rule.strip().partition("|")
        for name in names.split():
            if codes in ("DZ", "TZ"):
                c = "3|3|3" if name in ("d", "dt", "t", "th") else "4|4|4"
            else:
                c = codes
            table.append((name, *[x.split("/") for x in c.split("|")]))
    return sorted(table, key=lambda r: -len(r[0]))


@lru_cache(maxsize=1 << 14)
def daitch_mokotoff(w: str) -> tuple[str, ...]:
    """Six-digit codes of a name; letters that have two readings give a code for each."""
    global DM_RULES
    DM_RULES = DM_RULES or _dm_table()
    w = re.sub("[^a-z]", "", _plain(w.lower()))
    if not w:
        return ()
    codes, at = [("", None)], 0
    while at < len(w):
        name, start, before, other = next((r for r in DM_RULES if w.startswith(r[0], at)), (w[at], [""], [""], [""]))
        follows = w[at + len(name) : at + len(name) + 1]
        options = start if at == 0 else before if follows and follows in "aeiou" else other
        grown = []
        for code, last in codes:
            for o in options:
                same = o and last == o and not (name in ("mn", "nm"))
                grown.append((code if same else code + o, o))
        codes, at = list(dict.fromkeys(grown)), at + len(name)
    return tuple(dict.fromkeys((c + "000000")[:6] for c, _ in codes))


def word_delimiter(term: str, options: dict) -> list[tuple[str, int]]:
    """Parts of a term at delimiters, changes of case and between letters and digits, with their places from 0 on; catenations and the original stand where they begin."""
    on = lambda name, default: options.get(name, default)
    if term in set(options.get("protectedWords", ())):
        return [(term, 0)]
    text = re.sub(r"['’][sS]$", "", term) if on("stemEnglishPossessive", True) else term
    parts: list[str] = []
    for r in re.findall(r"[^\W_]+", text):
        cuts = r
        if on("splitOnCaseChange", True):
            cuts = re.sub(r"(?<=[a-zà-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])", "\x00", cuts)
        if on("splitOnNumerics", True):
            cuts = re.sub(r"(?<=[^\W\d_])(?=\d)|(?<=\d)(?=[^\W\d_])", "\x00", cuts)
        parts += cuts.split("\x00")
    out = [(term, 0)] if on("preserveOriginal", False) and parts != [term] else []
    shown = [p.isdigit() and on("generateNumberParts", True) or not p.isdigit() and on("generateWordParts", True) for p in parts]
    out += [(p, sum(shown[:k])) for k, p in enumerate(parts) if shown[k]]
    for wanted, kind in (("concatenateWords", (False,)), ("concatenateNumbers", (True,)), ("concatenateAll", (False, True))):
        own = [k for k, p in enumerate(parts) if p.isdigit() in kind]
        if on(wanted, False) and len(own) > 1:
            out.append(("".join(parts[k] for k in own), sum(shown[: own[0]])))
    return sorted(dict.fromkeys(out), key=lambda x: x[1])
