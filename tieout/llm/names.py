"""Names of people as they are typed, printed and misread: tokens, phonetic codes, similarity."""

import re
import unicodedata
from functools import lru_cache

#: Forename -> short and written-out-short forms.
NICKNAMES: dict[str, str] = {
    "abigail": "abby gail", "alexandra": "alex lexi sandra", "andrew": "andy drew", "anthony": "tony anth", "benjamin": "ben benny",
    "charles": "charlie chuck chas", "christopher": "chris kit topher", "cynthia": "cindy cyn", "daniel": "dan danny", "deborah": "deb debbie",
    "dorothy": "dot dottie dolly", "edward": "ed eddie ted", "eleanor": "ellie nell nora", "elizabeth": "liz beth betty eliz", "francis": "frank fran",
    "frederick": "fred freddy fredk", "gerald": "gerry jerry", "gregory": "greg gregg", "gwendolyn": "gwen wendy", "harold": "hal harry",
    "isabella": "bella izzy", "jacqueline": "jackie jacqui", "james": "jim jimmy jas", "jennifer": "jen jenny jenn", "jonathan": "jon jonny",
    "joseph": "joe joey jos", "katherine": "kate katie kath kathy", "lawrence": "larry lars", "leonard": "len lenny", "margaret": "maggie meg peggy marg marge",
    "matthew": "matt matty", "michael": "mike mick michl", "natalie": "nat natale talia", "nicholas": "nick nicky nichs", "oliver": "ollie",
    "pamela": "pam pammy", "patricia": "pat trish patty", "philip": "phil pip", "raymond": "ray", "rebecca": "becca becky", "richard": "rich dick richd",
    "robert": "rob bob bobby robt", "samuel": "sam sammy saml", "stephen": "steve stevie", "susan": "sue susie", "theresa": "terry tess tessa",
    "thomas": "tom tommy thos", "timothy": "tim timmy", "ursula": "ursy", "victoria": "vicky tori", "vincent": "vince vinny", "walter": "walt wally",
    "william": "will bill billy wm", "yvonne": "eve vonnie", "zachary": "zach zack",
}
_FULL: dict[str, frozenset[str]] = {}
for _name, _short in NICKNAMES.items():
    for _s in _short.split():
        _FULL[_s] = _FULL.get(_s, frozenset()) | {_name}
#: Particles that belong to the surname after them; endings and titles that belong to no name.
PARTICLES = frozenset("van von de la le du di del della der den st saint mac mc o al el ten ter bin".split())
DROPPED = frozenset("jr sr ii iii iv mr mrs ms miss dr prof esq".split())
#: Letters by sound, as in the usual soundex; vowels and h, w, y have none.
_SOUND = {c: d for d, own in {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in own}
#: Letters that misread print shows for one letter.
MISREAD = (("rn", "m"), ("ri", "n"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("nn", "m"))
_TWO = re.compile("|".join(two for two, _ in MISREAD))
_BROKEN = re.compile("[ÃÂâ][\x80-\xbf€-™]")


def repaired(s: str) -> str:
    """UTF-8 that was read as Latin-1 or Windows-1252, set right; anything else as it is."""
    if _BROKEN.search(s):
        for kind in ("latin-1", "cp1252"):
            try:
                return s.encode(kind).decode("utf-8")
            except UnicodeError:
                pass
    return s


@lru_cache(maxsize=40_000)
def tokens(name: str) -> tuple[str, ...]:
    """Parts of a name in order: lower case without accents, particles joined to what follows, titles and endings
    dropped, hyphens as breaks. Digits and question marks within a word stand for any letter, written ``?``."""
    s = name
    if not s.isascii():
        s = unicodedata.normalize("NFKD", repaired(s))
        s = "".join(c for c in s if not unicodedata.combining(c))
    s = s.lower()
    s = re.sub(r"['’`]", "", s)
    out, held = [], ""
    for t in re.findall(r"[^\W_](?:[^\W_]|\?)*|\?+[^\W_](?:[^\W_]|\?)*", s):
        if not any(c.isalpha() for c in t):
            continue
        t = re.sub(r"\d", "?", t)
        if t in DROPPED:
            continue
        if t in PARTICLES and len(t) > 1:
            held += t
            continue
        out.append(held + t)
        held = ""
    return tuple(out + [held] * bool(held))


def sound(token: str, length: int = 6) -> str:
    """Phonetic code: the first letter's class, then the classes of the consonants, no class twice running. Unknown
    letters are left out."""
    out = ""
    for c in token:
        d = _SOUND.get(c, "")
        if d and (not out or out[-1] != d):
            out += d
    return (out or token[:1])[:length]


@lru_cache(maxsize=20_000)
def full_forms(token: str) -> frozenset[str]:
    """The forenames that a token may stand for: itself, and those it is a short form of."""
    return _FULL.get(token, frozenset()) | {token}


def codes(parts: tuple[str, ...]) -> set[str]:
    """Blocking keys of a name, each from the phonetic codes of its sorted parts.

    For the parts longer than an initial: the codes of every two of them, whole and with one sound left out, so that names that differ by one letter of any kind share a key; the start of the longest part with the
    first letters of the others, for parts cut short; a single part by itself. Nicknames stand for their full names too, neighbouring parts of longer names also as one."""
    long = sorted(t for t in parts if len(t.replace("?", "")) > 1)
    short = sorted({t[0] for t in parts if len(t) == 1 and t != "?"})
    out: set[str] = set()

    def pair(a: str, b: str) -> None:
        x, y = sorted((sound(a), sound(b)))
        out.add(f"{x}.{y}")
        near = abs(len(a) - len(b)) <= 1
        for long_, short_ in [(a, b)] * (near or len(a) > len(b)) + [(b, a)] * (near or len(b) > len(a)):
            whole, rest = sound(long_, 9), sound(short_, 3)
            out.add(f"-{whole}.{rest}")
            for i in range(len(whole)):
                out.add(f"-{whole[:i] + whole[i + 1 :]}.{rest}")
            for i in range(len(rest)):
                out.add(f"-{whole}.{rest[:i] + rest[i + 1 :]}")

    if len(long) > 2:  # neighbours that another source writes as one
        whole_parts = [t for t in parts if len(t) > 1]
        for i in range(len(whole_parts) - 1):
            for t in whole_parts[:i] + whole_parts[i + 2 :]:
                for f in full_forms(t):
                    pair(whole_parts[i] + whole_parts[i + 1], f)
    for i, a in enumerate(long):
        for b in long[i + 1 :]:
            for fa in full_forms(a):
                for fb in full_forms(b):
                    pair(fa, fb)
        others = {f[0] for j, t in enumerate(long) if j != i for f in full_forms(t)} | set(short)
        for o in others:
            out.add(f"{a[:4]}~{o}")
            out.add(f"{sound(a, 9)}~{o}")
    if len(long) == 1:
        out.add(f"{sound(long[0], 9)}!")
    return out


def _place(c: str, rest: str, low: int, high: int) -> int:
    """The first place from ``low`` to before ``high`` of a letter that agrees with ``c``, -1 if there is none; taken ones
    are ``\\0``."""
    if c == "?":
        return next((j for j in range(low, min(high, len(rest))) if rest[j] != "\0"), -1)
    j, open_ = rest.find(c, low, high), rest.find("?", low, high)
    return j if open_ < 0 or 0 <= j < open_ else open_


def misread(a: str, b: str) -> bool:
    """Whether two parts of a name are equal but for letters that misread print shows for one."""
    if _TWO.search(a) or _TWO.search(b):
        for two, one in MISREAD:
            if (two in a or two in b) and a.replace(two, one) == b.replace(two, one):
                return True
    return False


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity; ``?`` agrees with any letter."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    left, rest = [], b
    for i, c in enumerate(a):
        j = _place(c, rest, max(0, i - reach), i + reach + 1)
        if j >= 0:
            left.append((c, j))
            rest = f"{rest[:j]}\0{rest[j + 1 :]}"
    m = len(left)
    if not m:
        return 0.0
    right = sorted([j for _, j in left])
    half = sum([b[j] != c and c != "?" and b[j] != "?" for (c, _), j in zip(left, right)]) / 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    start = 0
    for c, d in zip(a[:4], b[:4]):
        if c != d and c != "?" and d != "?":
            break
        start += 1
    return jaro + start * 0.1 * (1 - jaro)


def edits(a: str, b: str) -> int:
    """Letters to put in, take out, change or swap with a neighbour, 3 for any number over 2; ``?`` agrees with any letter.
    What both begin and end with is set aside first, so that little is left to compare."""
    if abs(len(a) - len(b)) > 2:
        return 3
    n, m = len(a), len(b)
    i = 0
    while i < n and i < m and (a[i] == b[i] or a[i] == "?" or b[i] == "?"):
        i += 1
    while n > i and m > i and (a[n - 1] == b[m - 1] or a[n - 1] == "?" or b[m - 1] == "?"):
        n -= 1
        m -= 1
    a, b = a[i:n], b[i:m]
    if not a or not b:
        return min(max(len(a), len(b)), 3)
    if len(a) == 1 or len(b) == 1:
        short, long = (a, b) if len(a) == 1 else (b, a)
        return len(long) - (short in long or "?" in long or short == "?")
    if len(a) == 2 and a == b[::-1]:
        return 1
    before, last = [], list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        now = [i]
        for j, d in enumerate(b, 1):
            cost = 0 if c == d or c == "?" or d == "?" else 1
            best = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + cost)
            if cost and i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        if min(now) > 2:
            return 3
        before, last = last, now
    return min(last[-1], 3)


@lru_cache(maxsize=20_000)
def _letters(token: str) -> frozenset[str]:
    return frozenset(token)


#: Least likeness of parts of three letters or more that differ by one edit.
ONE_EDIT = 0.87


@lru_cache(maxsize=100_000)
def token_likeness(a: str, b: str) -> float:
    """How alike two parts of a name are, 0 to 1: equal, nickname, cut short, initial, else Jaro-Winkler, held down where
    the parts differ by more than one edit. Parts that share less than half of their letters are unlike."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        full = full_forms(a) if len(a) > 1 else full_forms(b)
        one = a if len(a) == 1 else b
        return 0.8 if any(f[0] == one or one == "?" or f[0] == "?" for f in full) else 0.0
    fa, fb = full_forms(a), full_forms(b)
    if not fa.isdisjoint(fb):
        return 0.97
    x, y = (a, b) if len(a) <= len(b) else (b, a)
    unread = "?" in a or "?" in b
    if len(x) >= 3 and (y.startswith(x) or unread and all(c == d or c == "?" or d == "?" for c, d in zip(x, y))):
        return 0.93
    if misread(x, y):
        return 0.94
    best = 0.4
    for f in fa:
        for g in fb:
            sf, sg = _letters(f), _letters(g)
            if not unread and 2 * len(sf & sg) < max(len(sf), len(sg)):
                continue
            near = jaro_winkler(f, g)
            if near > 0.8:
                n = edits(f, g)
                near = max(near, ONE_EDIT) if n <= 1 else min(near, 0.88 if n == 2 and min(len(f), len(g)) >= 6 else 0.8)
            best = max(best, near if (f, g) == (a, b) else 0.97 * near)
    return best


def name_likeness(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """How alike two names are whatever the order of their parts, 0 to 1."""
    return compared(a, b)[0]


def worst_part(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """The likeness of the least alike pair when the parts are paired best first; initials count."""
    return compared(a, b)[1]


@lru_cache(maxsize=40_000)
def compared(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[float, float]:
    """How alike two names are whatever the order of their parts, and the likeness of the least alike pair of parts.

    Parts are paired best first, weighted by length; initials without a partner don't count, other parts without one
    count a little against. Of the least alike, initials count where no longer part is left to pair."""
    if not a or not b:
        return 0.0, 0.0
    if a == b:
        return 1.0, 1.0
    pairs = sorted([(token_likeness(x, y), min(len(x), len(y)), i, j) for i, x in enumerate(a) for j, y in enumerate(b)], reverse=True)
    ia, jb, total, weight, whole, worst = set(), set(), 0.0, 0.0, 0, 1.0
    longer = min(sum([len(t) > 1 for t in a]), sum([len(t) > 1 for t in b]))
    for s, short, i, j in pairs:
        if i in ia or j in jb:
            continue
        ia.add(i)
        jb.add(j)
        w = min(max(len(a[i]), len(b[j])), 6) if short > 1 else 2.0
        total += w * s
        weight += w
        whole += short > 1 and s > 0.8
        if short > 1 or len(ia) <= longer:
            worst = min(worst, s)
    like = _score(total, weight, whole, a, b, ia, jb)
    if len(a) != len(b) and max(len(a), len(b)) > 2:
        return max((like, worst), _glued(a, b))
    return like, worst


def _glued(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[float, float]:
    """The comparison when two neighbouring parts of the name with more parts are one part of the other."""
    few, many = (a, b) if len(a) < len(b) else (b, a)
    best = (0.0, 0.0)
    for i in range(len(many) - 1):
        if min(len(many[i]), len(many[i + 1])) > 2:
            joined = many[:i] + (many[i] + many[i + 1],) + many[i + 2 :]
            if len(joined) == len(few) and any(token_likeness(many[i] + many[i + 1], t) >= ONE_EDIT for t in few):
                like, worst = compared(few, joined)
                best = max(best, (0.99 * like, worst))
    return best


def _score(total: float, weight: float, whole: int, a: tuple[str, ...], b: tuple[str, ...], ia: set[int], jb: set[int]) -> float:
    lone = [x for i, x in enumerate(a) if i not in ia and len(x) > 1] + [y for j, y in enumerate(b) if j not in jb and len(y) > 1]
    for x in lone:
        weight += 0.25 * min(len(x), 6)
    return total / weight if whole else 0.5 * total / weight
