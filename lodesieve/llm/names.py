"""Names of persons and organisations as comparable tokens.

``parse_name`` undoes what doesn't change the name: case, accents, scripts, order marks, titles, payment remarks, legal
forms, abbreviations, nicknames. ``compare`` aligns the tokens of two names by longest-common-subsequence ratio and
says whether they can be the same name; ``similarity`` is the ratio itself.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

# fixed values: Cyrillic letters in Latin
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґ", ["a", "b", "v", "g", "d", "e", "e", "zh", "z", "i", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "kh", "ts", "ch", "sh", "shch", "", "y", "", "e", "yu", "ya", "i", "i", "e", "g"], strict=True))
_LETTERS = str.maketrans(CYRILLIC | {"ı": "i", "ß": "ss", "ø": "o", "đ": "d", "ł": "l", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th"})
# fixed values: titles and remarks that payers add
NOISE = frozenset("mr mrs ms miss dr prof sir sr jr herr frau mme sheikh sheik haji hajji gen general col colonel capt captain maj major eng attn accounts account acc ref re rent salary consulting fee fees front po box invoice inv payment pmt dept department c o care of the and und et y e de del la von van bin ibn al el da do dos".split())
REMARK = frozenset("attn accounts account ref rent salary consulting fee fees front po box invoice payment pmt".split())
# fixed values: usual short and pet forms by formal name, in English, Spanish, Russian, Turkish, Arabic and African use
FORMAL = {
    "abdallah": "abboud", "abdoulaye": "abdou", "ahmad": "hamoudi", "alexander": "alex alec alik al sandy sasha sanya shura xander", "alexandra": "sandra sasha lexi", "alexei": "alyosha lyosha", "alfred": "alfie fred", "amanda": "mandy", "anastasia": "nastya stasia", "andrei": "andryusha",
    "andrew": "andy drew", "anna": "anya annie", "anthony": "tony", "antonio": "tono toni", "arthur": "art", "barbara": "barb babs", "benjamin": "ben benny", "boris": "borya", "carlos": "carlitos", "catherine": "cathy", "charles": "charlie chuck chas", "christina": "tina", "christopher": "chris kit topher",
    "concepcion": "concha", "daniel": "dan danny", "david": "dave davey", "deborah": "deb debbie", "dmitri": "dima mitya", "donald": "don donnie", "dorothy": "dot dottie", "eduardo": "lalo edu", "edward": "ed eddie ned ted teddy", "elena": "lena", "elizabeth": "beth bess betty eliza liz lizzie", "emmanuel": "manu",
    "enrique": "quique kike", "fatima": "fatoom", "francisco": "paco pancho", "frederick": "fred freddy freddie", "fyodor": "fedya", "gabriel": "gabi gabe", "george": "georgie", "gerald": "gerry", "grigori": "grisha", "gregory": "greg", "guadalupe": "lupe lupita", "harold": "hal harry", "hassan": "hassoun",
    "henry": "hank harry", "ibrahim": "ibo", "ibrahima": "ibou", "ignacio": "nacho", "igor": "gosha", "irina": "ira", "ivan": "vanya", "james": "jamie jim jimmy", "jennifer": "jen jenn jenny", "jesus": "chucho chuy", "jose": "pepe", "joseph": "joe joey", "john": "johnny jack", "joshua": "josh",
    "katherine": "kate kathy katie kay", "kenneth": "ken kenny", "khadija": "dija", "konstantin": "kostya", "lawrence": "larry", "leonard": "len lenny", "manuel": "manolo", "margaret": "maggie meg peggy", "maria": "mary masha", "matthew": "matt", "mehmet": "memo", "michael": "mick mickey mike", "mikhail": "misha",
    "mohammed": "hamada mohamed muhammad", "mustafa": "musti mustik", "nadezhda": "nadya", "natalia": "natasha", "nicholas": "nick nicky", "nikolai": "kolya", "olga": "olya", "patricia": "pat patty trish", "patrick": "pat paddy", "pavel": "pasha", "peter": "pete", "pyotr": "petya", "rafael": "rafa",
    "raymond": "ray", "richard": "dick rich rick ricky", "robert": "bob bobby rob robbie", "roberto": "beto", "ronald": "ron ronnie", "samuel": "sam sammy", "sergei": "serge seryozha", "sofia": "sonya", "stephen": "steve", "susan": "sue susie", "svetlana": "sveta", "tatiana": "tanya",
    "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky", "viktor": "vitya", "virginia": "ginny", "vladimir": "vova volodya", "walter": "walt", "william": "bill billy liam will willy", "yekaterina": "katya", "yevgeny": "zhenya", "yuri": "yura", "yusuf": "yusi",
}
_FULL: dict[str, list[str]] = {}
for _full, _short in FORMAL.items():
    for _n in _short.split():
        _FULL.setdefault(_n, []).append(_full)
NICKNAMES = {n: full[0] for n, full in _FULL.items() if len(full) == 1 and n not in FORMAL}
# short for more than one name: kept as typed, equal to each of them
SEVERAL = {n: tuple(full) for n, full in _FULL.items() if len(full) > 1 and n not in FORMAL}
# fixed values: words of firm names by common form. Legal forms are dropped, scope words may be left out by a payer
LEGAL = frozenset("llc ooo limited ltd company co corp corporation inc incorporated jsc ao pjsc pao oao zao plc gmbh fze as sa ag nv bv liability joint stock public anonim sirketi sociedad anonima societe anonyme free zone establishment gesellschaft mbh mit beschrankter haftung beschraenkter open".split())
SCOPE = {w: k for k, ws in {"national": "natl", "international": "intl", "general": "gnl gen", "central": "cntrl", "united": "utd", "global": "glob", "group": "gp grp", "first": "st 1st", "marine": "mar"}.items() for w in (k, *ws.split())}
SECTOR = {
    w: k
    for k, ws in {
        "machinery": "mach", "holding": "holdings hldg", "industries": "industry ind inds", "foundation": "fdn found", "technologies": "technology tech", "chemicals": "chemical chem", "security": "sec", "petroleum": "petro petr oil", "aviation": "avn air", "shipping": "ship shpg maritime",
        "investment": "investments invest inv", "logistics": "logistic log", "agricultural": "agri agro agriculture", "construction": "constr const", "trading": "trade trad trdg", "metals": "metal", "minerals": "mineral mins", "electronics": "electronic elec electr", "exchange": "exch exchg", "engineering": "eng engg",
        "association": "assn assoc", "communications": "communication comms", "consulting": "consult consultants", "development": "dev", "enterprises": "enterprise ent", "finance": "financial fin", "insurance": "ins", "laboratories": "laboratory labs lab", "management": "mgmt mgt", "manufacturing": "mfg manuf",
        "pharmaceuticals": "pharmaceutical pharma", "products": "product prod", "resources": "resource res", "services": "service svc svcs", "systems": "sys", "telecommunications": "telecom telecoms", "textiles": "textile", "transport": "transportation transp", "university": "univ",
    }.items()
    for w in (k, *ws.split())
}
_FIRM_ONLY = frozenset("gen eng ind mar first st co as sa ao log sec inv const found air ship oil metal trade and dev ent fin ins lab labs res sys prod service consult assoc consulting product resource".split())

_MARKS = re.compile("[̀-ͯ]+")
_DOTTED = re.compile(r"\b(?:[^\W\d_]\.){2,}(?:[^\W\d_]\b)?")
_CAMEL = re.compile(r"(?<=[a-zà-öø-ÿğışçñ])(?=[A-ZÀ-ÖØ-ÞĞİŞÇÑ]\w{2})")
_WORD = re.compile(r"[a-z]+")
_REMARKS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|//.*$|\d+")
_DIGIT_LETTER = re.compile(r"(?<=[A-Za-z])[013456789](?=[A-Za-z])|(?<=[A-Za-z]{3})[013456789](?![A-Za-z0-9])")
_GLUED = re.compile(r"(?<=[A-Z])(?=[A-Z][a-z]{3})(?<![A-Za-z][A-Z])")
_GLUED_AL = re.compile(r"(?<=[a-z]{3})(?=(?:al|el)-[a-z]{3})")
_PHRASES = re.compile(r"\b(?:p\.? ?o\.? ?box|c/o|a/c|m/s)(?![a-z])|\b(?:front desk|front office|consulting fee)\b", re.I)
_AL = re.compile(r"\b(?:[Aa]l|[Ee]l|AL|EL)[- ](?=[^\W\d_]{3})|\bAl(?=[A-Z][a-z])|\bEl(?=[A-Z][a-z])")


def _mutate(t: str) -> str:
    """A token without the differences that transliterations and look-alike letters make; vowels are kept, as one letter each."""
    t = _SCH.sub("s", t).replace("y", "i")
    t = t.replace("rn", "m").replace("cl", "d")
    t = t.replace("tch", "ch").replace("ph", "f").replace("x", "ks").replace("ou", "u").replace("oo", "u").replace("uu", "u").replace("ie", "i").replace("ee", "i")
    t = _H.sub("", t).translate(_SIMPLE)
    return _RUN.sub(r"\1", t)


_SCH = re.compile("sch|sh")
_H = re.compile("(?<=[bcdgkpqtvwz])h|(?<=[aeiou])h$")
_RUN = re.compile(r"(.)\1+")
_SIMPLE = str.maketrans({"c": "k", "q": "k", "w": "v", "f": "v", "o": "u"})
_VOWEL = re.compile("(?<!^)[aeiu]+")


@lru_cache(maxsize=200_000)
def skeleton(t: str) -> str:
    """Consonants of a token, transliterations levelled; a leading vowel is kept."""
    s = _RUN.sub(r"\1", _VOWEL.sub("", _mutate(t)))
    return s or t[:1]


@lru_cache(maxsize=200_000)
def mutated(t: str) -> str:
    return _mutate(t)


@dataclass(frozen=True)
class Name:
    """``core``: tokens that make the name (persons: all; firms: the coined words). ``sector``, ``scope``: of firms."""

    firm: bool
    core: tuple[str, ...]
    sector: frozenset[str] = frozenset()
    scope: frozenset[str] = frozenset()

    @property
    def key(self) -> str:
        return "|".join(("F" if self.firm else "P", " ".join(self.core), " ".join(sorted(self.sector)), " ".join(sorted(self.scope))))


def from_key(key: str) -> Name:
    kind, core, sector, scope = key.split("|")
    return Name(kind == "F", tuple(core.split()), frozenset(sector.split()), frozenset(scope.split()))


def fold(text: str) -> str:
    """Latin letters without accents, case kept."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFC", text)
    low = "".join(_up(c, text[i + 1 : i + 2], text[i - 1 : i] if i else "") for i, c in enumerate(text))
    return _MARKS.sub("", unicodedata.normalize("NFKD", low))


def _up(c: str, after: str, before: str) -> str:
    if c.isascii():
        return c
    low = c.lower()
    t = low.translate(_LETTERS) if len(low) == 1 else low
    if c == low:
        return t
    # a letter that becomes several ones is upper case as a whole within an upper-case word
    return t.upper() if len(t) < 2 or after.isupper() or before.isupper() and not after.islower() else t.capitalize()


_DIGITS = {"0": "o", "3": "e", "4": "a", "5": "s", "6": "b", "7": "t", "8": "b", "9": "g"}


def _digit(m: re.Match) -> str:
    """The letter a digit inside a word stands for; 1 is an l beside a vowel, else an i."""
    beside = m.string[max(0, m.start() - 1) : m.start()] + m.string[m.end() : m.end() + 1]
    letter = _DIGITS.get(m[0]) or ("l" if any(c in "aeiouyAEIOUY" for c in beside) else "i")
    return letter.upper() if beside[-1:].isupper() or len(beside) < 2 and beside.isupper() else letter


def parse_name(text: str | None) -> Name | None:
    """None if no name is left."""
    if not text:
        return None
    s = fold(text)
    s = _PHRASES.sub(" ", s)
    s = _DIGIT_LETTER.sub(_digit, s)
    s = _REMARKS.sub(" ", s.replace("'", "").replace("’", "").replace("`", ""))
    s = _DOTTED.sub(lambda m: m[0].replace(".", "") + " ", s)
    s = _AL.sub(" ", _GLUED_AL.sub(" ", s))
    s = _GLUED.sub(" ", _CAMEL.sub(" ", s))
    words = _WORD.findall(s.lower())
    legal = [w for w in words if w in LEGAL]
    firm = bool(legal) or sum(w in SECTOR for w in words if w not in _FIRM_ONLY) > 0 or "foundation" in words
    if firm:
        sector = frozenset(SECTOR[w] for w in words if w in SECTOR)
        scope = frozenset(SCOPE[w] for w in words if w in SCOPE and w not in SECTOR)
        core = tuple(w for w in words if w not in SECTOR and w not in SCOPE and w not in LEGAL and w not in REMARK and w not in ("the", "and", "und", "mr", "attn") and len(w) > 1)
        return Name(True, core, sector, scope) if core else None
    core = [w for w in words if w not in NOISE or len(w) == 1]
    core = [NICKNAMES.get(w, w) for w in core]
    return Name(False, tuple(core)) if core else None


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


INITIAL = 0.7


def slips(a: str, b: str) -> int:
    """Letters that are not in the longest common subsequence: 1 for one left out, 2 for one wrong or two swapped."""
    return len(a) + len(b) - 2 * lcs_length(a, b)


SHAKY = 0.8  # below it a pair of tokens is near only in view of the rest of the name


@lru_cache(maxsize=400_000)
def similarity(a: str, b: str) -> float:
    """Longest-common-subsequence ratio of two tokens; 1 for the same name, .97 if only the transliteration differs, INITIAL
    for an initial, 0 if they differ by more than about one slip beside the transliteration."""
    if a == b or b in SEVERAL.get(a, ()) or a in SEVERAL.get(b, ()):
        return 1.0
    n, m = max(len(a), len(b)), min(len(a), len(b))
    if m == 1:
        return INITIAL if a[0] == b[0] else 0.0
    x, y = mutated(a), mutated(b)
    if x == y:
        return 0.97
    if m < 3 or n - m > 3:
        return 0.0
    if m >= 4 and any(slips(s, t) <= 1 for s, t in [*((a, s) for s in FORMAL.get(b, "").split() if len(s) > 3), *((b, s) for s in FORMAL.get(a, "").split() if len(s) > 3)]):
        return 0.97  # a pet form, misspelt
    raw, near = slips(a, b), slips(x, y)
    same = near <= 1 and raw <= 4 and n >= 6 or skeleton(a) == skeleton(b) and len(skeleton(a)) >= 4 and raw <= 3
    return 1 - raw / (n + m) if raw <= 1 or raw <= 2 and (n >= 5 or n == m) or same else 0.0


@dataclass(frozen=True)
class Vocabulary:
    """What is known of tokens: in how many listed names they stand, and in how many typed ones."""

    listed: dict[str, int]
    typed: dict[str, int]
    common: float = 8  # listed names from which on a token is a usual given or middle name
    real: float = 3  # typed names from which on an unlisted token is taken for a name of its own, not a slip
    rarer: int = 5  # a listed token that stands in this many times fewer names than another may be a slip of it

    def slip_possible(self, typed: str, listed: str) -> bool:
        """A typed token that is a known name is that name, not a misspelling of another, unless that one is far more usual."""
        n = self.listed.get(typed, 0)
        return n * self.rarer <= self.listed.get(listed, 0) and (n > 0 or self.typed.get(typed, 0) < self.real)

    def usual(self, t: str) -> bool:
        return len(t) == 1 or self.listed.get(t, 0) >= self.common

    def two_names(self, a: str, b: str) -> bool:
        """Both are usual names, and the vowels tell them apart."""
        return a != b and self.usual(a) and self.usual(b) and a.replace("o", "u") == b.replace("o", "u")


def align(typed: tuple[str, ...], listed: tuple[str, ...], known: Vocabulary) -> tuple[list[tuple[int, int, float]], list[int], list[int]]:
    """Pairs of token positions, best first, and the positions left on either side."""
    scored = []
    for i, x in enumerate(typed):
        for j, y in enumerate(listed):
            s = similarity(x, y)
            if s and (s == 1 or s >= 0.97 and not known.two_names(x, y) or s == INITIAL or known.slip_possible(x, y)):
                scored.append((-s, -len(x), i, j))
    used_a: set[int] = set()
    used_b: set[int] = set()
    pairs = []
    for s, _, i, j in sorted(scored):
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            pairs.append((i, j, -s))
    return pairs, [i for i in range(len(typed)) if i not in used_a], [j for j in range(len(listed)) if j not in used_b]


def _joined(one: str, many: list[str]) -> bool:
    """One word that is several written together."""
    return any(slips(one, t) <= 2 and len(one) > 7 for t in ("".join(many), "".join(reversed(many))))


def compare(typed: Name, listed: Name, known: Vocabulary) -> float:
    """0 if the typed name can't be the listed one, else the mean ratio of the aligned tokens by their letters.

    Firms: every coined word must have its partner; the kinds of business must not contradict, scope words neither.
    Persons: a rare word without partner speaks against it, usual given or middle names may be left out on one side, and
    the first name beside the rarest one must be the same on both sides, or its initial."""
    if typed.firm != listed.firm and not (typed.core and typed.core == listed.core):
        return 0.0
    a, b = typed.core, listed.core
    # words without a possible partner speak against it; so long texts are told apart without aligning them
    if (typed.firm or listed.firm) and abs(len(a) - len(b)) > 1 or any(sum(not known.usual(t) for t in x) > len(y) + 2 for x, y in ((a, b), (b, a))):
        return 0.0
    pairs, left, right = align(a, b, known)
    score = sum((len(a[i]) + len(b[j])) * s for i, j, s in pairs) / max(1, sum(len(a[i]) + len(b[j]) for i, j, _ in pairs))
    if typed.firm or listed.firm:
        if typed.sector - listed.sector and listed.sector - typed.sector or typed.scope - listed.scope and listed.scope - typed.scope:
            return 0.0
        if left or right:
            one, many = ([a[i] for i in left], [b[j] for j in right]) if len(left) == 1 else ([b[j] for j in right], [a[i] for i in left])
            return 0.95 if len(one) == 1 and len(many) == 2 and _joined(one[0], many) else 0.0
        return score
    shaky = [k for k, (_, _, s) in enumerate(pairs) if s < SHAKY and s != INITIAL]
    if shaky and (len(shaky) > 1 or len(pairs) < 2 or any(s < 0.97 for k, (_, _, s) in enumerate(pairs) if k not in shaky)):
        return 0.0
    # "d" beside a name of several words is short for "de ...", whose other word it doesn't begin with
    for x, xs, y, ys in ((a, left, b, right), (b, right, a, left)):
        if len(xs) == 1 and x[xs[0]] == "d" and len(ys) == 1 and known.usual(y[ys[0]]):
            left, right = [], []
            break
    if left and right:
        one, many = ([a[i] for i in left], [b[j] for j in right]) if len(left) == 1 else ([b[j] for j in right], [a[i] for i in left])
        return 0.95 if not pairs and len(one) == 1 and 2 <= len(many) <= 3 and _joined(one[0], many) else 0.0
    if not pairs or any(not known.usual(a[i]) for i in left) or any(not known.usual(b[j]) for j in right):
        return 0.0
    if len(a) == 1 or len(b) == 1:
        return score if len(a) == len(b) and score >= 0.97 else 0.0
    # an initial stands for a name only if no full name is left over beside it
    for i, j, s in pairs:
        if s == INITIAL and (len(a[i]) == 1 and any(len(a[k]) > 1 for k in left) or len(b[j]) == 1 and any(len(b[k]) > 1 for k in right)):
            return 0.0
    partner = {j: (i, s) for i, j, s in pairs}
    rarest = min((j for j in range(len(b)) if len(b[j]) > 1), key=lambda j: (known.listed.get(b[j], 0), -len(b[j]), j), default=None)
    if rarest is None or rarest not in partner or partner[rarest][1] == INITIAL or len(pairs) < 2:
        return 0.0
    if known.usual(b[rarest]) and any(s == INITIAL for _, _, s in pairs):
        return 0.0  # a usual name and an initial could be anybody
    own = partner[rarest][0]
    first_typed = next(i for i in range(len(a)) if i != own)
    first_listed = next(j for j in range(len(b)) if j != rarest)
    same = first_listed in partner and partner[first_listed][0] == first_typed
    return score if same else 0.0
