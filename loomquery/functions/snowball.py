"""The Snowball stemmers of nine languages besides English, by the published descriptions of the algorithms.

A stemmer works on a ``_Word``: the letters left, the regions in which suffixes count, and the operations that the
descriptions are written in. Suffixes are always tried longest first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable


def _longest(text: str) -> tuple[str, ...]:
    return tuple(sorted(set(text.split()), key=len, reverse=True))


class _Word:
    """Letters with R1, R2 and RV as positions: a suffix is in a region if it begins there or later."""

    def __init__(self, letters: str, vowels: str):
        self.w, self.vowels = letters, vowels
        self.r1 = self.after(0)
        self.r2 = self.after(self.r1)
        self.rv = len(letters)

    def after(self, start: int) -> int:
        """Behind the first non-vowel that follows a vowel, from start on."""
        for i in range(start + 1, len(self.w)):
            if self.w[i] not in self.vowels and self.w[i - 1] in self.vowels:
                return i + 1
        return len(self.w)

    def suffix(self, options: Iterable[str], at: int = 0) -> str:
        """The longest of the suffixes (in that order) that the word has from a position on."""
        for s in options:
            if self.w.endswith(s) and len(self.w) - len(s) >= at:
                return s
        return ""

    def inside(self, suffix: str, at: int) -> bool:
        return len(self.w) - len(suffix) >= at

    def cut(self, suffix: str, put: str = "") -> None:
        self.w = self.w[: len(self.w) - len(suffix)] + put

    def drop(self, options: str | tuple[str, ...], at: int) -> bool:
        """Delete a suffix that is in a region."""
        s = self.suffix((options,) if isinstance(options, str) else options)
        if s and self.inside(s, at):
            self.cut(s)
            return True
        return False

    def before(self, suffix: str, n: int = 1) -> str:
        """The n letters before a suffix."""
        end = len(self.w) - len(suffix)
        return self.w[max(0, end - n) : end]


def _mark(w: str, vowels: str, between: str = "", after: str = "") -> str:
    """Letters that stand for consonants in upper case: those between vowels, those after a vowel."""
    out = list(w)
    for i, c in enumerate(w):
        prev, follow = out[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else ""
        if (c in between and prev and prev in vowels and follow and follow in vowels) or (c in after and prev and prev in vowels):
            out[i] = c.upper()
    return "".join(out)


def _romance_rv(w: str, vowels: str) -> int:
    """RV of Spanish, Italian and Portuguese."""
    if len(w) < 2:
        return len(w)
    if w[1] not in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] in vowels), len(w))
    if w[0] in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in vowels), len(w))
    return min(3, len(w))


# German

_DE = "aeiouyäöü"
_DE_1, _DE_2, _DE_3 = _longest("em ern er e en es s"), _longest("en er est st"), _longest("end ung ig ik isch lich heit keit")


def german(word: str) -> str:
    s = _Word(_mark(word.replace("ß", "ss"), _DE, between="uy"), _DE)
    s.r1 = max(s.r1, min(3, len(s.w)))
    found = s.suffix(_DE_1)
    if found and s.inside(found, s.r1) and (found != "s" or s.before("s") in tuple("bdfghklmnrt")):
        s.cut(found)
        if found in ("e", "en", "es") and s.w.endswith("niss"):
            s.cut("s")
    found = s.suffix(_DE_2)
    if found and s.inside(found, s.r1) and (found != "st" or (s.before("st") in tuple("bdfghklmnt") and len(s.w) >= 6)):
        s.cut(found)
    found = s.suffix(_DE_3)
    if found and s.inside(found, s.r2) and not (found in ("ig", "ik", "isch") and s.before(found) == "e"):
        s.cut(found)
        if found in ("end", "ung"):
            if s.w.endswith("ig") and s.before("ig") != "e":
                s.drop("ig", s.r2)
        elif found in ("lich", "heit"):
            s.drop(("er", "en"), s.r1)
        elif found == "keit":
            s.drop(("lich", "ig"), s.r2)
    return s.w.lower().translate(str.maketrans("äöü", "aou"))


# Dutch

_NL = "aeiouyè"
_NL_1, _NL_3 = _longest("heden en ene s se"), _longest("end ing ig lijk baar bar")


def _undouble(s: _Word) -> None:
    if s.w.endswith(("kk", "dd", "tt")):
        s.w = s.w[:-1]


def _nl_en(s: _Word, suffix: str) -> None:
    if s.inside(suffix, s.r1) and s.before(suffix) and s.before(suffix) not in _NL and s.before(suffix, 3) != "gem":
        s.cut(suffix)
        _undouble(s)


def _nl_e(s: _Word) -> bool:
    if s.w.endswith("e") and s.inside("e", s.r1) and s.before("e") and s.before("e") not in _NL:
        s.cut("e")
        _undouble(s)
        return True
    return False


def dutch(word: str) -> str:
    w = word.translate(str.maketrans("äáëéïíöóüú", "aaeeiioouu"))
    w = "Y" + w[1:] if w.startswith("y") else w
    s = _Word(_mark(w, _NL, between="i", after="y"), _NL)
    s.r1 = max(s.r1, min(3, len(s.w)))
    found = s.suffix(_NL_1)
    if found == "heden":
        if s.inside(found, s.r1):
            s.cut(found, "heid")
    elif found in ("en", "ene"):
        _nl_en(s, found)
    elif found and s.inside(found, s.r1) and s.before(found) and s.before(found) not in _NL + "j":
        s.cut(found)
    e_found = _nl_e(s)
    if s.w.endswith("heid") and s.inside("heid", s.r2) and s.before("heid") != "c":
        s.cut("heid")
        if s.w.endswith("en"):
            _nl_en(s, "en")
    found = s.suffix(_NL_3)
    if found and s.inside(found, s.r2):
        if found in ("end", "ing"):
            s.cut(found)
            if s.w.endswith("ig") and s.inside("ig", s.r2) and s.before("ig") != "e":
                s.cut("ig")
            else:
                _undouble(s)
        elif found == "ig":
            if s.before("ig") != "e":
                s.cut("ig")
        elif found == "lijk":
            s.cut("lijk")
            _nl_e(s)
        elif found == "baar" or e_found:
            s.cut(found)
    if len(s.w) >= 4 and s.w[-1] not in _NL + "I" and s.w[-3:-1] in ("aa", "ee", "oo", "uu") and s.w[-4] not in _NL:
        s.w = s.w[:-2] + s.w[-1]
    return s.w.lower()


# Swedish and Norwegian

_SV, _NO = "aeiouyäåö", "aeiouyæåø"
_SV_1 = _longest("a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast s")
_NO_1 = _longest("a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast s erte ert")
_NO_3 = _longest("leg eleg ig eig lig elig els lov elov slov hetslov")


def swedish(word: str) -> str:
    s = _Word(word, _SV)
    s.r1 = max(s.r1, min(3, len(s.w)))
    found = s.suffix(_SV_1, s.r1)
    if found and (found != "s" or s.before("s") in tuple("bcdfghjklmnoprtvy")):
        s.cut(found)
    if s.suffix(("dd", "gd", "nn", "dt", "gt", "kt", "tt"), s.r1):
        s.w = s.w[:-1]
    found = s.suffix(("fullt", "löst", "lig", "els", "ig"), s.r1)
    if found:
        s.cut(found, {"fullt": "full", "löst": "lös"}.get(found, ""))
    return s.w


def norwegian(word: str) -> str:
    s = _Word(word, _NO)
    s.r1 = max(s.r1, min(3, len(s.w)))
    found = s.suffix(_NO_1, s.r1)
    if found in ("erte", "ert"):
        s.cut(found, "er")
    elif found and (found != "s" or s.before("s") in tuple("bcdfghjlmnoprtvyz") or (s.before("s") == "k" and s.before("s", 2)[:1] not in tuple(_NO) and len(s.w) > 2)):
        s.cut(found)
    if s.suffix(("dt", "vt"), s.r1):
        s.w = s.w[:-1]
    s.cut(s.suffix(_NO_3, s.r1))
    return s.w


# Spanish

_ES = "aeiouáéíóúü"
_ES_PRONOUNS = _longest("me se sela selo selas selos la le lo las les los nos")
_ES_STANDARD = {
    **dict.fromkeys("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split(), "plain"),
    **dict.fromkeys("adora ador ación adoras adores aciones acion ante antes ancia ancias".split(), "ic"),
    **dict.fromkeys("logía logías".split(), "log"), **dict.fromkeys("ución uciones".split(), "u"), **dict.fromkeys("encia encias".split(), "ente"),
    "amente": "amente", "mente": "mente", **dict.fromkeys("idad idades".split(), "idad"), **dict.fromkeys("iva ivo ivas ivos".split(), "iva"),
}
_ES_ORDER = _longest(" ".join(_ES_STANDARD))
_ES_Y = _longest("ya ye yan yen yeron yendo yo yó yas yes yais yamos")
_ES_VERBS = _longest(
    "en es éis emos arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
)
_ACUTE = str.maketrans("áéíóú", "aeiou")


def _adverb(s: _Word, after: tuple[str, ...]) -> None:
    """What an adverb's ending leaves: iv, and at before it, or one of others, in R2."""
    if s.w.endswith("iv"):
        if s.drop("iv", s.r2):
            s.drop("at", s.r2)
    else:
        s.drop(after, s.r2)


def _standard(s: _Word, kinds: dict[str, str], order: tuple[str, ...], mente: tuple[str, ...], adverb: tuple[str, ...]) -> bool:
    """Step 1 of Spanish and Portuguese."""
    found = s.suffix(order)
    kind = kinds.get(found)
    if kind is None:
        return False
    if kind == "amente":
        if not s.inside(found, s.r1):
            return False
        s.cut(found)
        _adverb(s, adverb)
        return True
    if kind == "ira":
        if not s.inside(found, s.rv) or s.before(found) != "e":
            return False
        s.cut(found, "ir")
        return True
    if not s.inside(found, s.r2):
        return False
    s.cut(found, {"log": "log", "u": "u", "ente": "ente"}.get(kind, ""))
    if kind == "ic":
        s.drop("ic", s.r2)
    elif kind == "mente":
        s.drop(mente, s.r2)
    elif kind == "idad":
        s.drop(("abil", "ic", "iv"), s.r2)
    elif kind == "iva":
        s.drop("at", s.r2)
    return True


def spanish(word: str) -> str:
    s = _Word(word, _ES)
    s.rv = _romance_rv(word, _ES)
    found = s.suffix(_ES_PRONOUNS)
    if found and s.inside(found, s.rv):
        stem = _Word(s.w[: len(s.w) - len(found)], _ES)
        verb = stem.suffix(("iéndo", "iendo", "yendo", "ándo", "ando", "ár", "ér", "ír", "ar", "er", "ir"))
        if verb and stem.inside(verb, s.rv) and (verb != "yendo" or stem.before("yendo") == "u"):
            s.w = stem.w.removesuffix(verb) + verb.translate(_ACUTE)
    if not _standard(s, _ES_STANDARD, _ES_ORDER, ("ante", "able", "ible"), ("os", "ic", "ad")):
        found = s.suffix(_ES_Y, s.rv)
        if found and s.before(found) == "u":
            s.cut(found)
        else:
            found = s.suffix(_ES_VERBS, s.rv)
            s.cut(found)
            if found in ("en", "es", "éis", "emos") and s.w.endswith("gu"):
                s.cut("u")
    found = s.suffix(("os", "a", "o", "á", "í", "ó", "e", "é"), s.rv)
    s.cut(found)
    if found in ("e", "é") and s.w.endswith("gu") and s.inside("u", s.rv):
        s.cut("u")
    return s.w.translate(_ACUTE)


# Portuguese

_PT = "aeiouáéíóúâêô"
_PT_STANDARD = {
    **dict.fromkeys("eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância".split(), "plain"),
    **dict.fromkeys("logia logias".split(), "log"), **dict.fromkeys("uça~o uço~es".split(), "u"), **dict.fromkeys("ência ências".split(), "ente"),
    "amente": "amente", "mente": "mente", **dict.fromkeys("idade idades".split(), "idad"), **dict.fromkeys("iva ivo ivas ivos".split(), "iva"), **dict.fromkeys("ira iras".split(), "ira"),
}
_PT_ORDER = _longest(" ".join(_PT_STANDARD))
_PT_VERBS = _longest(
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes "
    "is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
)


def portuguese(word: str) -> str:
    w = word.replace("ã", "a~").replace("õ", "o~")
    s = _Word(w, _PT)
    s.rv = _romance_rv(w, _PT)
    altered = _standard(s, _PT_STANDARD, _PT_ORDER, ("ante", "avel", "ível"), ("os", "ic", "ad"))
    if not altered:
        found = s.suffix(_PT_VERBS, s.rv)
        s.cut(found)
        altered = bool(found)
    if altered:
        if s.w.endswith("ci") and s.inside("i", s.rv):
            s.cut("i")
    else:
        s.cut(s.suffix(("os", "a", "i", "o", "á", "í", "ó"), s.rv))
    found = s.suffix(("e", "é", "ê"), s.rv)
    if found:
        s.cut(found)
        if s.w.endswith(("gu", "ci")) and s.inside("u", s.rv):
            s.w = s.w[:-1]
    elif s.w.endswith("ç"):
        s.w = s.w[:-1] + "c"
    return s.w.replace("a~", "ã").replace("o~", "õ")


# Italian

_IT = "aeiouàèìòù"
_IT_PRONOUNS = _longest("ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene")
_IT_STANDARD = {
    **dict.fromkeys("anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti".split(), "plain"),
    **dict.fromkeys("azione azioni atore atori".split(), "ic"), **dict.fromkeys("logia logie".split(), "log"), **dict.fromkeys("uzione uzioni usione usioni".split(), "u"), **dict.fromkeys("enza enze".split(), "ente"),
    **dict.fromkeys("amento amenti imento imenti".split(), "rv"), "amente": "amente", "ità": "ità", **dict.fromkeys("ivo ivi iva ive".split(), "ivo"),
}
_IT_ORDER = _longest(" ".join(_IT_STANDARD))
_IT_VERBS = _longest(
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
)


def italian(word: str) -> str:
    w = word.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    s = _Word(_mark(w, _IT, between="ui"), _IT)
    s.rv = _romance_rv(s.w, _IT)
    found = s.suffix(_IT_PRONOUNS)
    if found:
        stem = _Word(s.w[: len(s.w) - len(found)], _IT)
        verb = stem.suffix(("ando", "endo", "ar", "er", "ir"))
        if verb and stem.inside(verb, s.rv):
            s.w = stem.w + ("e" if len(verb) == 2 else "")
    found = s.suffix(_IT_ORDER)
    kind = _IT_STANDARD.get(found)
    region = {"rv": s.rv, "amente": s.r1}.get(kind, s.r2)
    if kind and s.inside(found, region):
        s.cut(found, {"log": "log", "u": "u", "ente": "ente"}.get(kind, ""))
        if kind == "ic":
            s.drop("ic", s.r2)
        elif kind == "amente":
            _adverb(s, ("abil", "os", "ic"))
        elif kind == "ità":
            s.drop(("abil", "ic", "iv"), s.r2)
        elif kind == "ivo" and s.drop("at", s.r2):
            s.drop("ic", s.r2)
    else:
        s.cut(s.suffix(_IT_VERBS, s.rv))
    if s.drop(tuple("aeioàèìò"), s.rv):
        s.drop("i", s.rv)
    if s.w.endswith(("ch", "gh")) and s.inside("ch", s.rv):
        s.cut("h")
    return s.w.lower()


# French

_FR = "aeiouyâàëéêèïîôûù"
_FR_STANDARD = {
    **dict.fromkeys("ance iqUe isme able iste eux ances iqUes ismes ables istes".split(), "plain"), **dict.fromkeys("atrice ateur ation atrices ateurs ations".split(), "ic"), **dict.fromkeys("logie logies".split(), "log"),
    **dict.fromkeys("usion ution usions utions".split(), "u"), **dict.fromkeys("ence ences".split(), "ent"), **dict.fromkeys("ement ements".split(), "ement"), **dict.fromkeys("ité ités".split(), "ité"), **dict.fromkeys("if ive ifs ives".split(), "if"),
    "eaux": "eau", "aux": "aux", **dict.fromkeys("euse euses".split(), "euse"), **dict.fromkeys("issement issements".split(), "issement"), "amment": "amment", "emment": "emment", **dict.fromkeys("ment ments".split(), "ment"),
}
_FR_ORDER = _longest(" ".join(_FR_STANDARD))
_FR_I = _longest("îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it")
_FR_VERBS = _longest("ions é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions")
_FR_A = frozenset("âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split())


def _fr_marked(w: str) -> str:
    out = list(w)
    for i, c in enumerate(w):
        before, follow = i > 0 and out[i - 1] in _FR, i + 1 < len(w) and w[i + 1] in _FR
        if (c in "ui" and before and follow) or (c == "y" and (before or follow)) or (c == "u" and i > 0 and w[i - 1] == "q"):
            out[i] = c.upper()
    return "".join(out)


def _fr_rv(w: str) -> int:
    if w.startswith(("par", "col", "tap")) or (len(w) > 2 and w[0] in _FR and w[1] in _FR):
        return min(3, len(w))
    return next((i + 1 for i in range(1, len(w)) if w[i] in _FR), len(w))


def _fr_standard(s: _Word) -> bool:
    """Step 1; whether it removed an ending other than an adverb's."""
    found = s.suffix(_FR_ORDER)
    kind = _FR_STANDARD.get(found)
    r2 = bool(kind) and s.inside(found, s.r2)
    iqu = lambda: s.drop("ic", s.r2) or (s.w.endswith("ic") and s.cut("ic", "iqU"))
    if kind in ("plain", "log", "u", "ent", "ic", "ité", "if"):
        if not r2:
            return False
        s.cut(found, {"log": "log", "u": "u", "ent": "ent"}.get(kind, ""))
        if kind == "ic":
            iqu()
        elif kind == "ité":
            if s.w.endswith("abil"):
                if not s.drop("abil", s.r2):
                    s.cut("abil", "abl")
            elif s.w.endswith("ic"):
                iqu()
            else:
                s.drop("iv", s.r2)
        elif kind == "if" and s.drop("at", s.r2):
            iqu()
        return True
    if kind == "ement":
        if not s.inside(found, s.rv):
            return False
        s.cut(found)
        if s.w.endswith("iv"):
            if s.drop("iv", s.r2):
                s.drop("at", s.r2)
        elif s.w.endswith("eus"):
            if not s.drop("eus", s.r2) and s.inside("eus", s.r1):
                s.cut("eus", "eux")
        elif s.w.endswith(("abl", "iqU")):
            s.drop(("abl", "iqU"), s.r2)
        elif s.w.endswith(("ièr", "Ièr")) and s.inside("ièr", s.rv):
            s.cut("ièr", "i")
        return True
    if kind == "eau":
        s.cut(found, "eau")
        return True
    if kind == "aux" and s.inside(found, s.r1):
        s.cut(found, "al")
        return True
    if kind == "euse" and (r2 or s.inside(found, s.r1)):
        s.cut(found, "" if r2 else "eux")
        return True
    if kind == "issement" and s.inside(found, s.r1) and s.before(found) and s.before(found) not in _FR:
        s.cut(found)
        return True
    if kind in ("amment", "emment") and s.inside(found, s.rv):
        s.cut(found, "ant" if kind == "amment" else "ent")
    elif kind == "ment" and s.before(found) and s.before(found) in _FR and s.inside("x" + found, s.rv):
        s.cut(found)
    return False


def french(word: str) -> str:
    w = _fr_marked(word)
    s = _Word(w, _FR)
    s.rv = _fr_rv(w)
    done = _fr_standard(s)
    if not done:
        found = s.suffix(_FR_I, s.rv)
        if found and s.inside("x" + found, s.rv) and s.before(found) not in _FR:
            s.cut(found)
        else:
            found = s.suffix(_FR_VERBS, s.rv)
            if found and (found != "ions" or s.inside(found, s.r2)):
                s.cut(found)
                if found in _FR_A:
                    s.drop("e", s.rv)
    if s.w != w:
        if s.w.endswith("Y"):
            s.w = s.w[:-1] + "i"
        elif s.w.endswith("ç"):
            s.w = s.w[:-1] + "c"
    else:
        if s.w.endswith("s") and len(s.w) > 1 and s.w[-2] not in "aiouès":
            s.cut("s")
        found = s.suffix(("ière", "Ière", "ier", "Ier", "ion", "e", "ë"), s.rv)
        if found == "ion":
            if s.inside(found, s.r2) and s.before(found) in ("s", "t") and s.inside("xion", s.rv):
                s.cut(found)
        elif found in ("e", "ë"):
            if found == "e" or s.before(found, 2) == "gu":
                s.cut(found)
        elif found:
            s.cut(found, "i")
    if s.w.endswith(("enn", "onn", "ett", "ell", "eill")):
        s.w = s.w[:-1]
    return re.sub(rf"[éè]([^{_FR}]+)$", r"e\1", s.w).lower()


# Russian

_RU = "аеиоуыэюя"
_RU_GERUND, _RU_GERUND_A = _longest("ив ивши ившись ыв ывши ывшись"), _longest("в вши вшись")
_RU_ADJECTIVE = _longest("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею")
_RU_PARTICIPLE, _RU_PARTICIPLE_A = _longest("ивш ывш ующ"), _longest("ем нн вш ющ щ")
_RU_VERB = _longest("ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю")
_RU_VERB_A = _longest("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно")
_RU_NOUN = _longest("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я")


def _ru_drop(s: _Word, free: tuple[str, ...], after_a: tuple[str, ...] = ()) -> bool:
    """Delete the longest ending in RV; those of the second kind only after а or я."""
    for e in sorted({*free, *after_a}, key=len, reverse=True):
        if s.w.endswith(e) and s.inside(e, s.rv):
            if e in free or (s.before(e) in ("а", "я") and s.inside("x" + e, s.rv)):
                s.cut(e)
                return True
            return False
    return False


def russian(word: str) -> str:
    s = _Word(word.replace("ё", "е"), _RU)
    s.rv = next((i + 1 for i, c in enumerate(s.w) if c in _RU), len(s.w))
    if not _ru_drop(s, _RU_GERUND, _RU_GERUND_A):
        _ru_drop(s, ("ся", "сь"))
        if _ru_drop(s, _RU_ADJECTIVE):
            _ru_drop(s, _RU_PARTICIPLE, _RU_PARTICIPLE_A)
        elif not _ru_drop(s, _RU_VERB, _RU_VERB_A):
            _ru_drop(s, _RU_NOUN)
    _ru_drop(s, ("и",))
    s.drop(("ость", "ост"), max(s.r2, s.rv))
    if s.suffix(("ейше", "ейш"), s.rv):
        _ru_drop(s, ("ейше", "ейш"))
        if s.w.endswith("нн") and s.inside("нн", s.rv):
            s.cut("н")
    elif s.w.endswith("нн") and s.inside("нн", s.rv):
        s.cut("н")
    elif s.w.endswith("ь") and s.inside("ь", s.rv):
        s.cut("ь")
    return s.w


STEMMERS: dict[str, Callable[[str], str]] = {"spanish": spanish, "french": french, "german": german, "italian": italian, "dutch": dutch, "portuguese": portuguese, "russian": russian, "swedish": swedish, "norwegian": norwegian}
CODES = {"es": "spanish", "fr": "french", "de": "german", "it": "italian", "nl": "dutch", "pt": "portuguese", "ru": "russian", "sv": "swedish", "no": "norwegian", "en": "english"}


def stemmer(language: str) -> Callable[[str], str] | None:
    """The stemmer of a language by its name or code; None for English, and for any that isn't known, which counts as it."""
    name = (language or "").lower()
    return STEMMERS.get(CODES.get(name, name))
