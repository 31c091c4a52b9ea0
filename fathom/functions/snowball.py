"""Snowball stemmers, from their published descriptions, as plain functions of one lower-case term.

A word's regions are places in it: R1 begins after the first non-vowel that follows a vowel, R2 is the same within R1,
RV is what the Romance languages have. A suffix is in a region if it begins there. The suffix lists below are fixed
values of the algorithms.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache, partial


def region(w: str, vowels: str, start: int = 0) -> int:
    """Where the region after the first non-vowel that follows a vowel begins, looked for from `start` on."""
    for k in range(start + 1, len(w)):
        if w[k] not in vowels and w[k - 1] in vowels:
            return k + 1
    return len(w)


def regions(w: str, vowels: str, least: int = 0) -> tuple[int, int]:
    r1 = region(w, vowels)
    return max(r1, least), region(w, vowels, r1)


def romance_rv(w: str, vowels: str) -> int:
    if len(w) < 3:
        return len(w)
    if w[1] not in vowels:
        return next((k + 1 for k in range(2, len(w)) if w[k] in vowels), len(w))
    if w[0] in vowels:
        return next((k + 1 for k in range(2, len(w)) if w[k] not in vowels), len(w))
    return 3


def longest(w: str, suffixes: Iterable[str], at: int = 0) -> str:
    """The longest of the suffixes that w ends with, from `at` on; empty if there is none."""
    return max((s for s in suffixes if w.endswith(s) and len(w) - len(s) >= at), key=len, default="")


def without(w: str, suffix: str) -> str:
    return w[: len(w) - len(suffix)] if suffix else w


def dropped(w: str, at: int, *suffixes: str) -> str:
    """w without the longest of the suffixes, if it begins at `at` or later."""
    s = longest(w, suffixes)
    return without(w, s) if len(w) - len(s) >= at else w


def marked(w: str, vowels: str, letters: str) -> str:
    """Some letters between vowels in upper case: they are no vowels there."""
    out = list(w)
    for k in range(1, len(w) - 1):
        if w[k] in letters and out[k - 1] in vowels and w[k + 1] in vowels:
            out[k] = w[k].upper()
    return "".join(out)


# English

E_VOWELS = "aeiouy"
E_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
E_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
E_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
E_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
E_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def _short_end(w: str) -> bool:
    """Ends in a short syllable: vowel, non-vowel (not w, x, Y) after a non-vowel, or a vowel and a non-vowel alone."""
    if len(w) == 2:
        return w[0] in E_VOWELS and w[1] not in E_VOWELS
    return len(w) > 2 and w[-3] not in E_VOWELS and w[-2] in E_VOWELS and w[-1] not in E_VOWELS + "wxY"


def english(w: str) -> str:
    if len(w) < 3:
        return w
    if w in E_WHOLE:
        return E_WHOLE[w]
    w = w.removeprefix("'")
    w = re.sub(r"(^|(?<=[aeiouy]))y", "Y", w)
    head = re.match("gener|commun|arsen", w)
    r1 = head.end() if head else region(w, E_VOWELS)
    r2 = region(w, E_VOWELS, r1)
    w = without(w, longest(w, ("'", "'s", "'s'")))
    end = longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif end == "s" and any(c in E_VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in E_AFTER_1A:
        return w
    end = longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        w = without(w, end) + "ee" if len(w) - len(end) >= r1 else w
    elif end and any(c in E_VOWELS for c in without(w, end)):
        w = without(w, end)
        if w.endswith(("at", "bl", "iz")) or len(w) <= r1 and _short_end(w):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
            w = w[:-1]
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in E_VOWELS:
        w = w[:-1] + "i"
    end = longest(w, E_STEP2)
    if end and len(w) - len(end) >= r1 and (end != "ogi" or w[-4:-3] == "l") and (end != "li" or w[-3] in "cdeghkmnrt"):
        w = without(w, end) + E_STEP2[end]
    end = longest(w, E_STEP3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = without(w, end) + E_STEP3[end]
    end = longest(w, E_STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = without(w, end)
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


# Scandinavian languages

S_VOWELS, N_VOWELS = "aeiouyäåö", "aeiouyæåø"
S_ENDS = "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast".split()
N_ENDS = "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast".split()
D_ENDS = "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret".split()


def swedish(w: str) -> str:
    r1 = max(region(w, S_VOWELS), 3)
    end = longest(w, [*S_ENDS, "s"], r1)
    w = without(w, end) if end != "s" or w[-2:-1] in set("bcdfghjklmnoprtvy") else w
    w = w[:-1] if longest(w, "dd gd nn dt gt kt tt".split(), r1) else w
    end = longest(w, ("lig", "ig", "els", "löst", "fullt"), r1)
    return w[:-1] if end in ("löst", "fullt") else without(w, end)


def norwegian(w: str) -> str:
    r1 = max(region(w, N_VOWELS), 3)
    end = longest(w, [*N_ENDS, "s", "erte", "ert"], r1)
    if end in ("erte", "ert"):
        w = without(w, end) + "er"
    elif end != "s" or w[-2:-1] in set("bcdfghjlmnoprtvyz") or w[-2:-1] == "k" and w[-3:-2] not in set(N_VOWELS):
        w = without(w, end)
    w = w[:-1] if longest(w, ("dt", "vt"), r1) else w
    return without(w, longest(w, "leg eleg ig eig lig elig els lov elov slov hetslov".split(), r1))


def danish(w: str) -> str:
    r1 = max(region(w, N_VOWELS), 3)
    pair = lambda w: w[:-1] if longest(w, ("gd", "dt", "gt", "kt"), r1) else w
    end = longest(w, [*D_ENDS, "s"], r1)
    w = without(w, end) if end != "s" or w[-2:-1] in set("abcdfghjklmnoprtvyzå") else w
    w = pair(w)
    w = w[:-2] if w.endswith("igst") else w
    end = longest(w, ("ig", "lig", "elig", "els", "løst"), r1)
    w = w[:-1] if end == "løst" else pair(without(w, end)) if end else w
    return w[:-1] if len(w) - 1 >= r1 and len(w) > 1 and w[-1] == w[-2] and w[-1] not in N_VOWELS else w


# German and Dutch

G_VOWELS = "aeiouyäöü"


def german(w: str, spelled: bool = False) -> str:
    w = w.replace("ß", "ss")
    if spelled:  # as german2: vowels with an e for their umlaut
        w = re.sub("(?<!q)ue", "ü", w.replace("ae", "ä").replace("oe", "ö"))
    w = marked(w, G_VOWELS, "uy")
    r1, r2 = regions(w, G_VOWELS, 3)
    end = longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if end and len(w) - len(end) >= r1 and (end != "s" or w[-2] in "bdfghklmnrt"):
        w = without(w, end)
        w = w[:-1] if end in ("e", "en", "es") and w.endswith("niss") else w
    end = longest(w, ("en", "er", "est", "st"))
    if end and len(w) - len(end) >= r1 and (end != "st" or len(w) > 5 and w[-3] in "bdfghklmnt"):
        w = without(w, end)
    end = longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if end and len(w) - len(end) >= r2:
        rest = without(w, end)
        if end in ("end", "ung"):
            w = rest[:-2] if rest.endswith("ig") and len(rest) - 2 >= r2 and rest[-3:-2] != "e" else rest
        elif end in ("ig", "ik", "isch"):
            w = w if rest.endswith("e") else rest
        elif end == "keit":
            w = dropped(rest, r2, "lich", "ig")
        else:
            w = dropped(rest, r1, "er", "en")
    return w.lower().translate(str.maketrans("äöü", "aou"))


DU_VOWELS = "aeiouyè"


def dutch(w: str) -> str:
    w = w.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    w = re.sub("^y|(?<=[aeiouyè])y", "Y", w)
    w = re.sub("(?<=[aeiouyè])i(?=[aeiouyè])", "I", w)
    r1, r2 = regions(w, DU_VOWELS, 3)
    undoubled = lambda w: w[:-1] if w.endswith(("kk", "dd", "tt")) else w

    def without_en(w: str, end: str) -> str:
        rest = without(w, end)
        return undoubled(rest) if len(rest) >= r1 and rest and rest[-1] not in DU_VOWELS and not rest.endswith("gem") else w

    def without_e(w: str) -> tuple[str, bool]:
        return (undoubled(w[:-1]), True) if w.endswith("e") and len(w) - 1 >= r1 and w[-2] not in DU_VOWELS else (w, False)

    end = longest(w, ("heden", "en", "ene", "s", "se"))
    if end == "heden":
        w = without(w, end) + "heid" if len(w) - 5 >= r1 else w
    elif end in ("en", "ene"):
        w = without_en(w, end)
    elif end and len(w) - len(end) >= r1 and without(w, end)[-1:] not in set(DU_VOWELS + "j"):
        w = without(w, end)
    w, gone = without_e(w)
    if w.endswith("heid") and len(w) - 4 >= r2 and w[-5] != "c":
        w = w[:-4]
        w = without_en(w, "en") if w.endswith("en") else w
    end = longest(w, ("end", "ing", "ig", "lijk", "baar", "bar"))
    if end and len(w) - len(end) >= r2:
        rest = without(w, end)
        if end in ("end", "ing"):
            w = rest[:-2] if rest.endswith("ig") and len(rest) - 2 >= r2 and rest[-3:-2] != "e" else undoubled(rest)
        elif end == "ig":
            w = w if rest.endswith("e") else rest
        elif end == "lijk":
            w = without_e(rest)[0]
        elif end == "baar" or gone:
            w = rest
    if re.search("[^aeiouyè](aa|ee|oo|uu)[^aeiouyèI]$", w):
        w = w[:-2] + w[-1]
    return w.lower()


# Romance languages

ES_VOWELS = "aeiouáéíóúü"
ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
ES_DELETED = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
ES_AFTER_IC = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
ES_REPLACED = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
ES_Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
ES_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
ACUTE = str.maketrans("áéíóú", "aeiou")


def _adverb(w: str, rest: str, r1: int, r2: int, others: tuple[str, ...]) -> str:
    """amente: what is before it goes too, if it is a suffix in R2."""
    if len(rest) < r1:
        return w
    if rest.endswith("iv") and len(rest) - 2 >= r2:
        return dropped(rest[:-2], r2, "at")
    return dropped(rest, r2, *others)


def spanish(w: str) -> str:
    r1, r2 = regions(w, ES_VOWELS)
    rv = romance_rv(w, ES_VOWELS)
    if pronoun := longest(w, ES_PRONOUNS):
        rest = without(w, pronoun)
        verb = longest(rest, "iéndo ándo ár ér ír ando iendo ar er ir yendo".split())
        if verb and len(rest) - len(verb) >= rv and (verb != "yendo" or rest[:-5].endswith("u")):
            w = rest[: len(rest) - len(verb)] + verb.translate(ACUTE)
    before = w
    end = longest(w, [*ES_DELETED, *ES_AFTER_IC, *ES_REPLACED, "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"])
    rest = without(w, end)
    if end == "amente":
        w = _adverb(w, rest, r1, r2, ("os", "ic", "ad"))
    elif end and len(rest) >= r2:
        w = rest + ES_REPLACED.get(end, "")
        if end in ES_AFTER_IC:
            w = dropped(w, r2, "ic")
        elif end == "mente":
            w = dropped(w, r2, "ante", "able", "ible")
        elif end in ("idad", "idades"):
            w = dropped(w, r2, "abil", "ic", "iv")
        elif end in ("iva", "ivo", "ivas", "ivos"):
            w = dropped(w, r2, "at")
    if w == before:
        end = longest(w, ES_Y_VERBS, rv)
        if end and without(w, end).endswith("u"):
            w = without(w, end)
        elif end := longest(w, [*ES_VERBS, "en", "es", "éis", "emos"], rv):
            w = without(w, end)
            w = w[:-1] if end in ("en", "es", "éis", "emos") and w.endswith("gu") else w
    end = longest(w, ("os", "a", "o", "á", "í", "ó", "e", "é"), rv)
    w = without(w, end)
    if end in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
        w = w[:-1]
    return w.translate(ACUTE)


IT_VOWELS = "aeiouàèìòù"
IT_PRONOUNS = "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split()
IT_DELETED = "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti".split()
IT_AFTER_IC = "azione azioni atore atori".split()
IT_REPLACED = {"logia": "log", "logie": "log", "uzione": "u", "uzioni": "u", "usione": "u", "usioni": "u", "enza": "ente", "enze": "ente"}
IT_VERBS = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
).split()


def italian(w: str) -> str:
    w = w.translate(str.maketrans("áéíóú", "àèìòù"))
    w = marked(w.replace("qu", "qU"), IT_VOWELS, "ui")
    r1, r2 = regions(w, IT_VOWELS)
    rv = romance_rv(w, IT_VOWELS)
    if pronoun := longest(w, IT_PRONOUNS):
        rest = without(w, pronoun)
        verb = longest(rest, ("ando", "endo", "ar", "er", "ir"), rv)
        w = rest + ("e" if len(verb) == 2 else "") if verb else w
    before = w
    end = longest(w, [*IT_DELETED, *IT_AFTER_IC, *IT_REPLACED, "amento", "amenti", "imento", "imenti", "amente", "ità", "ivo", "ivi", "iva", "ive"])
    rest = without(w, end)
    if end in ("amento", "amenti", "imento", "imenti"):
        w = rest if len(rest) >= rv else w
    elif end == "amente":
        w = _adverb(w, rest, r1, r2, ("os", "ic", "abil"))
    elif end and len(rest) >= r2:
        w = rest + IT_REPLACED.get(end, "")
        if end in IT_AFTER_IC:
            w = dropped(w, r2, "ic")
        elif end == "ità":
            w = dropped(w, r2, "abil", "ic", "iv")
        elif end in ("ivo", "ivi", "iva", "ive") and w.endswith("at") and len(w) - 2 >= r2:
            w = dropped(w[:-2], r2, "ic")
    if w == before:
        w = without(w, longest(w, IT_VERBS, rv))
    if end := longest(w, tuple("aeioàèìò"), rv):
        w = without(w, end)
        w = w[:-1] if w.endswith("i") and len(w) - 1 >= rv else w
    if w.endswith(("ch", "gh")) and len(w) - 2 >= rv:
        w = w[:-1]
    return w.lower()


PT_VOWELS = "aeiouáéíóúâêô"
PT_DELETED = "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância".split()
PT_REPLACED = {"logia": "log", "logias": "log", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente"}
PT_VERBS = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
).split()


def portuguese(w: str) -> str:
    w = w.replace("ã", "a~").replace("õ", "o~")
    r1, r2 = regions(w, PT_VOWELS)
    rv = romance_rv(w, PT_VOWELS)
    before = w
    end = longest(w, [*PT_DELETED, *PT_REPLACED, "amente", "mente", "idade", "idades", "iva", "ivo", "ivas", "ivos", "ira", "iras"])
    rest = without(w, end)
    if end == "amente":
        w = _adverb(w, rest, r1, r2, ("os", "ic", "ad"))
    elif end in ("ira", "iras"):
        w = rest + "ir" if len(rest) >= rv and rest.endswith("e") else w
    elif end and len(rest) >= r2:
        w = rest + PT_REPLACED.get(end, "")
        if end == "mente":
            w = dropped(w, r2, "ante", "avel", "ível")
        elif end in ("idade", "idades"):
            w = dropped(w, r2, "abil", "ic", "iv")
        elif end in ("iva", "ivo", "ivas", "ivos"):
            w = dropped(w, r2, "at")
    if w == before:
        w = without(w, longest(w, PT_VERBS, rv))
    if w != before:
        w = w[:-1] if w.endswith("ci") and len(w) - 1 >= rv else w
    else:
        w = without(w, longest(w, ("os", "a", "i", "o", "á", "í", "ó"), rv))
    if end := longest(w, ("e", "é", "ê"), rv):
        w = without(w, end)
        w = w[:-1] if w.endswith(("gu", "ci")) and len(w) - 1 >= rv else w
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


FR_VOWELS = "aeiouyâàëéêèïîôûù"
FR_DELETED = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
FR_AFTER_IC = "atrice ateur ation atrices ateurs ations".split()
FR_REPLACED = {"logie": "log", "logies": "log", "usion": "u", "ution": "u", "usions": "u", "utions": "u", "ence": "ent", "ences": "ent"}
FR_I_VERBS = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
FR_E_VERBS = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
FR_A_VERBS = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def french(w: str) -> str:
    out = list(w)
    for k, c in enumerate(w):
        before, after = out[k - 1] if k else "", w[k + 1 : k + 2]
        if c in "ui" and before and before in FR_VOWELS and after and after in FR_VOWELS or c == "y" and (before and before in FR_VOWELS or after and after in FR_VOWELS) or c == "u" and before == "q":
            out[k] = c.upper()
    w = "".join(out)
    r1, r2 = regions(w, FR_VOWELS)
    if re.match("par|col|tap", w) or len(w) > 2 and w[0] in FR_VOWELS and w[1] in FR_VOWELS:
        rv = 3
    else:
        rv = next((k + 1 for k in range(1, len(w)) if w[k] in FR_VOWELS), len(w))
    start, verbs = w, False
    end = longest(w, [*FR_DELETED, *FR_AFTER_IC, *FR_REPLACED, "ement", "ements", "ité", "ités", "if", "ive", "ifs", "ives", "eaux", "aux", "euse", "euses", "issement", "issements", "amment", "emment", "ment", "ments"])
    rest = without(w, end)
    if end in FR_DELETED or end in FR_REPLACED:
        w = rest + FR_REPLACED.get(end, "") if len(rest) >= r2 else w
    elif end in FR_AFTER_IC:
        if len(rest) >= r2:
            w = rest if not rest.endswith("ic") else rest[:-2] + ("" if len(rest) - 2 >= r2 else "iqU")
    elif end in ("ement", "ements"):
        if len(rest) >= rv:
            w = rest
            inner = longest(rest, ("iv", "eus", "abl", "iqU", "ièr", "Ièr"))
            at = len(rest) - len(inner)
            if inner == "iv" and at >= r2:
                w = dropped(rest[:-2], r2, "at")
            elif inner == "eus":
                w = rest[:-3] if at >= r2 else rest[:-3] + "eux" if at >= r1 else rest
            elif inner in ("abl", "iqU") and at >= r2:
                w = rest[:-3]
            elif inner in ("ièr", "Ièr") and at >= rv:
                w = rest[:-3] + "i"
    elif end in ("ité", "ités"):
        if len(rest) >= r2:
            w = rest
            inner = longest(rest, ("abil", "ic", "iv"))
            at = len(rest) - len(inner)
            if inner in ("abil", "ic"):
                w = rest[:at] + ("" if at >= r2 else "abl" if inner == "abil" else "iqU")
            elif inner and at >= r2:
                w = rest[:at]
    elif end in ("if", "ive", "ifs", "ives"):
        if len(rest) >= r2:
            w = rest
            if rest.endswith("at") and len(rest) - 2 >= r2:
                w = rest[:-2]
                w = w[:-2] + ("" if len(w) - 2 >= r2 else "iqU") if w.endswith("ic") else w
    elif end == "eaux":
        w = rest + "eau"
    elif end == "aux":
        w = rest + "al" if len(rest) >= r1 else w
    elif end in ("euse", "euses"):
        w = rest if len(rest) >= r2 else rest + "eux" if len(rest) >= r1 else w
    elif end in ("issement", "issements"):
        w = rest if len(rest) >= r1 and rest[-1:] and rest[-1] not in FR_VOWELS else w
    elif end in ("amment", "emment"):
        w, verbs = (rest + ("ant" if end == "amment" else "ent"), True) if len(rest) >= rv else (w, False)
    elif end and len(rest) - 1 >= rv and rest[-1] in FR_VOWELS:
        w, verbs = rest, True
    if w == start or verbs:
        before = w
        end = longest(w, FR_I_VERBS, rv)
        if end and len(w) - len(end) - 1 >= rv and without(w, end)[-1] not in FR_VOWELS:
            w = without(w, end)
        if w == before:
            end = longest(w, [*FR_E_VERBS, *FR_A_VERBS, "ions"], rv)
            if end == "ions":
                w = without(w, end) if len(w) - 4 >= r2 else w
            elif end:
                w = without(w, end)
                w = w[:-1] if end in FR_A_VERBS and w.endswith("e") and len(w) - 1 >= rv else w
    if w != start:
        w = w[:-1] + {"Y": "i", "ç": "c"}.get(w[-1:], w[-1:])
    else:
        if w.endswith("s") and len(w) > 1 and w[-2] not in "aiouès":
            w = w[:-1]
        end = longest(w, ("ion", "ier", "ière", "Ier", "Ière", "e"), rv)
        if end == "ion":
            w = w[:-3] if len(w) - 3 >= r2 and w[-4:-3] in ("s", "t") and len(w) - 4 >= rv else w
        elif end:
            w = without(w, end) + ("" if end == "e" else "i")
    w = w[:-1] if w.endswith(("enn", "onn", "ett", "ell", "eill")) else w
    w = re.sub(f"[éè]([^{FR_VOWELS}]+)$", r"e\1", w)
    return w.lower()


# Russian

RU_VOWELS = "аеиоуыэюя"
RU_GERUND = ("в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split())
RU_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
RU_PARTICIPLE = ("ем нн вш ющ щ".split(), "ивш ывш ующ".split())
RU_VERB = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(), "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split())
RU_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def russian(w: str) -> str:
    w = w.replace("ё", "е")
    rv = next((k + 1 for k, c in enumerate(w) if c in RU_VOWELS), len(w))
    r2 = regions(w, RU_VOWELS)[1]

    def cut(w: str, groups: tuple[list[str], list[str]]) -> str:
        """Without the longest ending of the second group, or of the first after а or я."""
        end = longest(w, [s for g in groups for s in g], rv)
        first = end in groups[0] and end not in groups[1]
        rest = without(w, end)
        return w if first and not (rest[-1:] in ("а", "я") and len(rest) - 1 >= rv) else rest

    found = cut(w, RU_GERUND)
    if found == w:
        w = without(w, longest(w, ("ся", "сь"), rv))
        adjective = longest(w, RU_ADJECTIVE, rv)
        found = cut(without(w, adjective), RU_PARTICIPLE) if adjective else cut(w, RU_VERB)
        if not adjective and found == w:
            found = without(w, longest(w, RU_NOUN, rv))
    w = found
    w = w[:-1] if w.endswith("и") and len(w) - 1 >= rv else w
    w = without(w, longest(w, ("ост", "ость"), r2))
    if end := longest(w, ("ейш", "ейше"), rv):
        w = without(w, end)
        w = w[:-1] if w.endswith("нн") else w
    elif w.endswith("нн") or w.endswith("ь") and len(w) - 1 >= rv:
        w = w[:-1]
    return w


#: By the names that index definitions use; other languages have no stemmer here.
STEMMERS: dict[str, Callable[[str], str]] = {
    name: lru_cache(maxsize=1 << 15)(f)
    for name, f in {
        "danish": danish, "dutch": dutch, "english": english, "french": french, "german": german, "german2": partial(german, spelled=True), "italian": italian,
        "norwegian": norwegian, "portuguese": portuguese, "russian": russian, "spanish": spanish, "swedish": swedish,
    }.items()
}
