"""Personal data: detection and keyed surrogates that keep type and format.

Every detected entity is replaced by a surrogate drawn from HMAC-SHA256 over a
secret key, the entity's type and its normal form.  The same entity therefore
gets the same surrogate in all documents, whatever its spelling (coreference).
A surrogate keeps what the type shows: digits stay digits and letters stay
letters of the same case and script, punctuation stays; a phone number keeps its
country code, a card its first digit and a valid check digit, an address its
octet lengths, an e-mail its top-level domain (equal domains stay equal), a
titled person a given name of the title's gender, in ASCII, accented Latin or
Cyrillic letters as the real one.  Names have any number of words: initials,
particles (which stay), apostrophes, inner capitals and words in capitals.  The last
word is the surname, an entity of its own, so "Mr John Smith", "Mr SMITH" and "Dr
Smith" share one; given names are drawn by gender and whole name, and a mention whose
title tells no gender takes that of the same name, else of the same surname, in its
text if there is just one.

Collisions are checked over the whole corpus: a surrogate must differ from every
other surrogate and every real entity of its type, for people as printed, over all
genders.  Surnames and e-mail domains are checked by themselves; given names
within a surname and local parts within a domain, so whole names and addresses
differ too.  Entities that fail draw again
with the next round number until none fails.  Names get a syllable more with each
round.  The other kinds keep their shape for ``SHAPED_ROUNDS`` rounds; then values
grow by a character a round, and the octets of an address take any length and
from ``PORT_ROUNDS`` on a port number follows it.  So every entity settles,
however many there are.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored

DEFAULT_KEY = b"riskloom surrogate key"
SHAPED_ROUNDS = 4  # draws that keep the exact shape; later ones are wider
PORT_ROUNDS = 12
EXCEPTION_ROWS = 200_000  # redrawn entities sent to all tasks; more are joined

# Titles (fixed values) with the gender of the name that follows; empty: not told.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Dr": "", "Prof": "",
    "Herr": "m", "Frau": "f", "Monsieur": "m", "Mme": "f", "Madame": "f", "Mlle": "f",
    "Señor": "m", "Señora": "f", "Señorita": "f", "Sr": "m", "Sra": "f", "Г-н": "m", "Г-жа": "f",
}
GIVEN = {
    "m": "Adam Bruno Carl David Emil Felix Gustav Hugo Ivan Jonas Karl Leo Martin Noel Oscar Paul".split(),
    "f": "Ada Berta Clara Diana Emma Flora Greta Helena Irene Julia Karla Lena Marta Nora Olga Paula".split(),
}
ACCENTED = {
    "m": "André Björn Günter Héctor Jérôme Jörg José Léo Óscar Raúl René Sébastien Søren Tomás Víctor Zoltán".split(),
    "f": "Adèle Chloé Éva Hélène Inés Irène Léa Lucía Märta Mónica Noëlle Renée Sofía Sólveig Zoë Zsófia".split(),
}
CYRILLIC = {
    "m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Степан Юрий".split(),
    "f": "Алла Вера Галина Дарья Елена Зоя Ирина Ксения Лидия Марина Нина Ольга Полина Раиса Софья Юлия".split(),
}
# Lower-case words within names (fixed values); the second kind only behind one of the first.
LINKS = "de del della di da das do dos du van von vom ter bin ibn ben y".split()
INNER_LINKS = "la las los der den dem het zu".split()
PARTICLES = frozenset(LINKS + INNER_LINKS)
# Capitalised words that no name runs through (fixed values).
NO_NAME = "And Or But The An Of In On At To For From With By Is Was Are Were Has Had Said Email Mail Contact Dear Hello Hi Cc".split()
SYLLABLES = "ba be bo da de do fa fe ga go ka ke la le lo ma me mo na ne no ra re ro sa se so ta te to va ve".split()
ACCENT_SYLLABLES = [x[0] + "áéó"["aeo".index(x[1])] for x in SYLLABLES]
CYRILLIC_SYLLABLES = [c + v for c in "бвгдклмнпрст" for v in "аео"]

LETTER = r"[\p{L}\p{M}]"
BLANK = r"[ \t\xa0]+"
PART = (  # Smith, SMITH, McDonald, O'Brien, d'Angelo; not the 's of a possessive
    rf"(?:\p{{Ll}}['’]|(?:al|el)-)?\p{{Lu}}(?:{LETTER}+|(?=['’]\p{{Lu}}{LETTER}))"
    rf"(?:['’](?![sS](?!{LETTER}))\p{{Lu}}{LETTER}*)*(?!{LETTER})"
)
WORD = rf"(?!(?:{'|'.join([*TITLES, *NO_NAME])})(?![\w-])){PART}(?:-{PART})*"
LINK = rf"(?:{'|'.join(LINKS)})(?:{BLANK}(?:{'|'.join(INNER_LINKS)}))*"
LEAD = rf"(?:(?:{LINK}|{WORD}|(?![AI]\b)\p{{Lu}}){BLANK}|\p{{Lu}}\.-?(?:{BLANK})?)"
NAME = rf"{LEAD}*{WORD}"

PATTERNS = {
    "email": regex.compile(r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "secret": regex.compile(
        r"(?i)\b(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|token|passwd|password|pwd|auth)\b[\"']?\s*[=:]\s*"
        r"(?|\"([^\"\s]{6,})\"|'([^'\s]{6,})'|([^\s\"',;]{6,}))"
    ),
    "key": regex.compile(r"\b(?:AKIA|ASIA|ghp_|sk-|xox[bp]-)[A-Za-z0-9_-]{16,}"),
    "iban": regex.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "card": regex.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)"),
    "ip": regex.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)"),
    "phone": regex.compile(
        r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
        r"|\d{3} \d{3} \d{4}|0\d(?:[ .-]\d\d){4}|0\d{2,4}[ /]\d{5,8}|0\d{2,4} \d{3,4} \d{3,4})(?![\w-]|[ .]\d)"
    ),
    "ipv6": regex.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{3,39}(?![\w:]|\.\d)"),
    "ssn": regex.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "person": regex.compile(
        rf"\b({'|'.join(sorted(TITLES, key=len, reverse=True))})\.?{BLANK}({NAME})"
    ),
}
# Names of two words or more under a letter, and in front of an e-mail address, where
# words are taken one by one, backward.
ANY_PARTICLE = rf"(?:{'|'.join(sorted(PARTICLES))})(?!\w)"
WHOLE_NAME = regex.compile(rf"(?!{LINK}{BLANK}){LEAD}+{WORD}")
WORD_BEFORE = regex.compile(rf"(?r)(?<![\w'’-])(?:({WORD})|\p{{Lu}}\.|(?![AI]\b)\p{{Lu}}|({ANY_PARTICLE}))(?<=(\.)|.)({BLANK})?")
TO_EMAIL = regex.compile(r"(?r),? ?[<(\[]?(?:mailto:)?")
CLOSING = regex.compile(
    r"\b(?:[Rr]egards|[Ss]incerely|Yours (?:truly|faithfully)|[Gg]rüßen?|Cordialement|Saludos|Atentamente|Signed(?: by)?)[,:]?\s+"
)
LINE_END = regex.compile(r"\s*(?:[\n,.;]|$)")
ANY_SIGNED = regex.compile("egards|incerely|Yours|rüße|Cordialement|Saludos|Atentamente|Signed")
TOKEN = regex.compile(r"[^\s\xa0.]+\.?")  # a word of a name; an initial with its point
MENTION = regex.compile(rf"(?<![\w'’-])(?:{WORD}|\p{{Lu}}\b\.?|{ANY_PARTICLE})")
ANY_TITLE = regex.compile(r"\b(?:" + "|".join(TITLES) + r")\b")
HAS_SIGN = regex.compile(r"[A-Za-z0-9]")
LETTERS, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
MARKS = "!#$%&*+-./:=?@^_|~"  # drawn for a secret without letters and digits
HAS_DIGITS = regex.compile(r"\d{2}|\d[. -]\d")


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, gender) of the entities, in order; of overlapping ones the
    first, then the longest, then the type listed first."""
    digits = HAS_DIGITS.search(text) is not None
    wanted = []
    if "@" in text:
        wanted.append("email")
    if "=" in text or ":" in text:
        wanted.append("secret")
    if digits:
        wanted += ["iban", "card", "ip", "phone", "ssn"]
    if digits or "-" in text or "_" in text or "AKIA" in text or "ASIA" in text:
        wanted.append("key")
    if text.count(":") > 1:
        wanted.append("ipv6")
    if ANY_TITLE.search(text):
        wanted.append("person")
    found = []
    for kind in wanted:
        for m in PATTERNS[kind].finditer(text):
            if kind == "person":
                found.append((m.start(2), -m.end(2), kind, TITLES[m[1]]))
            elif kind == "ipv6":
                if _is_ipv6(m[0]):
                    found.append((m.start(), -m.end(), kind, ""))
            elif kind == "secret":
                if len(set(m[1])) > 1 or m[1][0].isalnum():  # not a mask such as ******** or a rule
                    found.append((m.start(1), -m.end(1), kind, ""))
            elif kind != "key" or HAS_SIGN.search(m[0], m[0].index("-") + 1 if "-" in m[0][:5] else 4):
                found.append((m.start(), -m.end(), kind, ""))
            if kind == "email":
                found += _name_before(text, TO_EMAIL.match(text, 0, m.start()).start())
    if ANY_SIGNED.search(text):
        for m in CLOSING.finditer(text):
            name = WHOLE_NAME.match(text, m.end())
            if name and LINE_END.match(text, name.end()):
                found.append((name.start(), -name.end(), "person", ""))
    if not found:
        return []
    found += _later_mentions(text, {text[a:-b] for a, b, kind, _ in found if kind == "person"})
    rank = {k: i for i, k in enumerate(PATTERNS)}
    found.sort(key=lambda x: (x[0], x[1], rank[x[2]]))
    out, at = [], 0
    for start, stop, kind, gender in found:
        if start >= at:
            out.append((start, -stop, kind, gender))
            at = -stop
    return _gendered(text, out)


def _name_before(text: str, stop: int) -> list[tuple[int, int, str, str]]:
    """The name of two words or more that ends at ``stop``, if there is one."""
    words, first, at, inner = 0, stop, stop, False
    while m := WORD_BEFORE.match(text, 0, at):
        word, particle, point, blank = m.groups()
        if bool(words) != bool(blank or point) or not (words or word):
            break
        if particle:
            inner = particle in INNER_LINKS or inner and particle not in LINKS
        elif inner:
            break  # such as "der" behind no "von"
        else:
            words, first = words + 1, m.start()
        at = m.start()
    return [(first, -stop, "person", "")] if words > 1 else []


def _is_ipv6(value: str) -> bool:
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return any(c.isdigit() for c in value)  # not C++ names such as a::b


def _lowered(value: str) -> str:
    if value.isascii():
        return value.lower()
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in value)


def _uppered(value: str) -> str:
    return "".join(c.upper() if len(c.upper()) == 1 else c for c in value)


@functools.lru_cache(65_536)
def _word(word: str) -> str:
    """A name's word as its spellings share it; capitalised words stay apart from particles."""
    low = _lowered(unicodedata.normalize("NFC", word)).replace("’", "'")
    return low.capitalize() if low in PARTICLES and word != low else low


def _words(name: str) -> tuple[str, ...]:
    return tuple(map(_word, TOKEN.findall(name)))


def _later_mentions(text: str, names: set[str]) -> list[tuple[int, int, str, str]]:
    """Mentions without title of the whole names and surnames that the text introduces."""
    known = {_words(n) for n in names}
    known |= {n[-1:] for n in known}
    if not known:
        return []
    marks = [(m.start(), m.end(), _word(m[0])) for m in MENTION.finditer(text)]
    # Sequences of words are told apart by a rolling hash of 127 bits, so a look costs
    # the same for a name of any length.
    ids: dict[str, int] = {}
    wanted: dict[str, dict[int, set[int]]] = {}
    for n in known:
        of_word = wanted.setdefault(n[0], {})
        of_word.setdefault(len(n), set()).add(_rolled(n, ids)[-1])
    upto = _rolled([w for _, _, w in marks], ids)
    power = [1]
    ends = list(range(1, len(marks) + 1))  # of the run of words with only blanks between
    for i in range(len(marks) - 2, -1, -1):
        if not text[marks[i][1] : marks[i + 1][0]].strip(" \t\xa0"):
            ends[i] = ends[i + 1]
    out = []
    for i, (start, stop, word) in enumerate(marks):
        for n, hashes in sorted(wanted.get(word, {}).items(), reverse=True):
            while len(power) <= n:
                power.append(power[-1] * ROLL % MERSENNE)
            if i + n <= ends[i] and (upto[i + n] - upto[i] * power[n]) % MERSENNE in hashes:
                out.append((start, -marks[i + n - 1][1], "person", ""))
                break
        else:
            at = start
            for part in text[start:stop].split("-") if "-" in word else ():
                if (_word(part),) in known:
                    out.append((at, -(at + len(part)), "person", ""))
                at += len(part) + 1
    return out


MERSENNE, ROLL = (1 << 127) - 1, 0x5DEECE66D1B2F3A4975310FEDCBA987


def _rolled(words, ids: dict[str, int]) -> list[int]:
    """Hashes of all beginnings of ``words``; ``ids`` numbers the words seen."""
    out = [0]
    for w in words:
        out.append((out[-1] * ROLL + ids.setdefault(w, len(ids) + 1)) % MERSENNE)
    return out


def _gendered(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """``found`` with the gender of people that only other mentions in the text tell."""
    told: dict[tuple[str, ...], set[str]] = {}
    for a, b, kind, gender in found:
        if kind == "person" and gender:
            name = _words(text[a:b])
            for n in (name, name[-1:]):
                told.setdefault(n, set()).add(gender)
    if not told:
        return found
    out = []
    for a, b, kind, gender in found:
        if kind == "person" and not gender:
            name = _words(text[a:b])
            genders = told.get(name) or told.get(name[-1:]) or ()
            gender = next(iter(genders)) if len(genders) == 1 else ""
        out.append((a, b, kind, gender))
    return out


def normal(kind: str, gender: str, value: str) -> str:
    """The form that spellings of one entity share."""
    if kind in ("card", "phone", "ssn"):
        digits = "".join(c for c in value if c.isdigit())
        return ("+" if value.startswith("+") else "") + digits
    if kind == "email":
        return _lowered(value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ipv6":
        return ipaddress.IPv6Address(value).compressed
    if kind == "person":
        return f"{gender}:{' '.join(_words(value))}"
    return value


def named(kind: str, gender: str, value: str) -> list[tuple[str, str]]:
    """(kind, norm) of what an occurrence's surrogate is drawn for."""
    norm = normal(kind, gender, value)
    if kind == "email":
        return [(kind, norm), ("domain", norm.rpartition("@")[2])]
    if kind == "person":
        *given, surname = norm.partition(":")[2].split(" ")
        return [("surname", surname)] + [(kind, norm)] * (not PARTICLES.issuperset(given))
    return [(kind, norm)]


class Draw:
    """Endless pseudo-random numbers below given bounds, keyed by an entity."""

    def __init__(self, key: bytes, *what: object):
        self.key, self.what = key, "\x1f".join(map(str, what)).encode()
        self.pool, self.n = 0, 0
        self.size = 1

    def below(self, n: int) -> int:
        if self.size < n << 32:
            block = hmac.new(self.key, self.what + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.pool, self.size, self.n = int.from_bytes(block, "big"), 1 << 256, self.n + 1
        self.pool, out = divmod(self.pool, n)
        self.size //= n
        return out

    def pick(self, items):
        return items[self.below(len(items))]


_ALIKE: dict[tuple, list[str]] = {}


def alike(c: str) -> list[str]:
    """Characters of the same class: digit, or letter of the same case and script."""
    if c.isdigit() and c.isascii():
        return list("0123456789")
    if c.isascii() and c.isalpha():
        return list("abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    script = unicodedata.name(c, "?").split(" ")[0]
    cell = (script, unicodedata.category(c), ord(c) >> 8)
    if cell not in _ALIKE:
        _ALIKE[cell] = [
            x
            for x in map(chr, range((ord(c) >> 8) << 8, ((ord(c) >> 8) + 1) << 8))
            if (unicodedata.name(x, "?").split(" ")[0], unicodedata.category(x)) == cell[:2]
            and (x == x.upper().lower() or not x.islower())  # so words in capitals differ as well
        ]
    return _ALIKE[cell]


def redrawn(draw: Draw, value: str, keep: int = 0) -> str:
    """``value`` with letters and digits behind the first ``keep`` characters replaced by like ones."""
    low_hex = all(c in "0123456789abcdef" for c in value)
    out = list(value[:keep])
    for c in value[keep:]:
        if not c.isalnum():
            out.append(c)
        elif low_hex and c.isalpha():
            out.append(draw.pick("abcdef"))
        else:
            out.append(draw.pick(alike(c) or [c]))
    return "".join(out)


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


COUNTRY_DIGITS = 2  # of a number's leading digits behind "+", when it has at least 11


def replaced(kind: str, norm: str, round_: int, key: bytes) -> str:
    """The surrogate's normal form; of an e-mail with the real domain, of a person
    with the real surname: these are drawn as entities of their own."""
    draw = Draw(key, kind, norm, round_)
    wider = max(0, round_ - SHAPED_ROUNDS + 1)  # characters that the value grows by

    def grown(chars: str) -> str:
        return "".join(draw.pick(chars) for _ in range(wider))

    if kind == "email":
        name, _, domain = norm.rpartition("@")
        return f"{redrawn(draw, name)}{grown(LETTERS)}@{domain}"
    if kind == "domain":
        head, _, top = norm.rpartition(".")
        return f"{redrawn(draw, head)}{grown(LETTERS)}.{top}"
    if kind == "card":
        body = redrawn(draw, norm, 1) + grown(DIGITS)
        if luhn_ok(norm):
            body = next(body[:-1] + c for c in DIGITS if luhn_ok(body[:-1] + c))
        return body
    if kind == "phone":
        if not norm.startswith("+"):
            return redrawn(draw, norm, norm.startswith("0")) + grown(DIGITS)
        keep = 1 + (1 if norm[1] in "17" else COUNTRY_DIGITS)
        return redrawn(draw, norm, keep) + grown(DIGITS)
    if kind == "ip":
        if wider:
            address = ".".join(str(draw.below(256)) for _ in range(4))
            more = round_ - PORT_ROUNDS + 1
            return address + (":" + "".join(draw.pick(DIGITS[1:]) for _ in range(more)) if more > 0 else "")
        return ".".join(
            str(draw.below(10) if len(o) == 1 else 10 + draw.below(90) if len(o) == 2 else 100 + draw.below(156))
            for o in norm.split(".")
        )
    if kind == "ipv6":
        if wider:
            return ":".join(f"{draw.below(0xF000) + 0x1000:x}" for _ in range(8))
        # Groups keep their length and zeros stay, so the form stays the shortest one.
        return ":".join(
            g if g in ("", "0") else draw.pick(HEX[1:]) + "".join(draw.pick(HEX) for _ in g[1:]) for g in norm.split(":")
        )
    if kind == "iban":
        return redrawn(draw, norm, 2) + grown(DIGITS)
    if kind == "key":
        for head in ("AKIA", "ASIA", "ghp_", "sk-", "xoxb-", "xoxp-"):
            if norm.startswith(head):
                return head + "".join(
                    draw.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" if c.isupper() or c.isdigit() else LETTERS) if c.isalnum() else c
                    for c in norm[len(head) :]
                ) + grown(LETTERS)
    if kind == "person" and " " in norm:
        gender, _, name = norm.partition(":")
        *given, surname = name.split(" ")
        out = [word if word in PARTICLES else _new_given(draw, gender, word) for word in given]
        last = max(i for i, word in enumerate(given) if word not in PARTICLES)
        out[last] += "".join("-" + draw.pick(_pool(gender, given[last])).lower() for _ in range(round_ - 1))
        return " ".join([*out, surname])
    if kind in ("person", "surname"):
        return _new_parts(norm.rpartition(":")[2], lambda part: _new_surname(draw, part, round_))
    if kind == "secret" and not any(c.isalnum() for c in norm):
        return "".join(draw.pick(MARKS) for _ in norm) + grown(MARKS)
    return redrawn(draw, norm) + grown(DIGITS if kind == "ssn" else LETTERS)


def _longer(draw: Draw, name: str, more: int) -> str:
    tail = alike(name[-1])
    return name + "".join(draw.pick(tail if len(tail) > 1 else LETTERS) for _ in range(more))


def _script(word: str) -> str:
    """ascii, LATIN (with accents), CYRILLIC, or empty for any other or mixed ones."""
    if word.isascii():
        return "ascii"
    found = {unicodedata.name(c, "?").split(" ")[0] for c in word if c.isalpha()}
    return found.pop() if found in ({"LATIN"}, {"CYRILLIC"}) else ""


def _pool(gender: str, word: str) -> list[str]:
    names = {"ascii": GIVEN, "LATIN": ACCENTED, "CYRILLIC": CYRILLIC}.get(_script(word), GIVEN)
    return names[gender] if gender else names["m"] + names["f"]


def _new_parts(word: str, new) -> str:
    """``word`` with the parts between hyphens and apostrophes replaced; a head such as o' or al- stays."""
    parts = regex.split("([-'])", word)
    tails = [*parts[1::2], ""]
    return "".join(
        (part if not part or tail == "'" and len(part) < 3 or tail == "-" and part in ("al", "el") else new(part)) + tail
        for part, tail in zip(parts[::2], tails, strict=True)
    )


def _new_given(draw: Draw, gender: str, word: str) -> str:
    if sum(c.isalpha() for c in word) == 1:  # an initial
        return redrawn(draw, word)
    return _new_parts(
        word, lambda part: draw.pick(_pool(gender, part)).lower() if _script(part) else redrawn(draw, part)
    )


def _new_surname(draw: Draw, part: str, round_: int) -> str:
    script = _script(part)
    if not script:
        return _longer(draw, redrawn(draw, part), round_)
    heads = {"ascii": SYLLABLES, "LATIN": ACCENT_SYLLABLES, "CYRILLIC": CYRILLIC_SYLLABLES}[script]
    rest = CYRILLIC_SYLLABLES if script == "CYRILLIC" else SYLLABLES
    return draw.pick(heads) + "".join(draw.pick(rest) for _ in range(2 + round_))


def _named_like(value: str, new: str) -> str:
    """A name's lower-case word ``new`` in the capitals and apostrophes of ``value``."""
    value = unicodedata.normalize("NFC", value)
    if value.isupper() and sum(map(str.isalpha, value)) > 1:
        return _uppered(new)
    old = regex.split("([-'’])", value)
    out = []
    for i, piece in enumerate(regex.split("([-'])", new)):
        if i % 2:
            out.append(old[i] if i < len(old) else piece)
        else:
            out.append(_cased(old[i] if i < len(old) else "A", piece))
    return "".join(out)


def shaped(kind: str, value: str, norm: str) -> str:
    """A surrogate's normal form in the spelling of the occurrence ``value``."""
    if kind in ("card", "phone", "ssn", "iban"):
        chars = iter(norm)
        return "".join(next(chars) if c.isalnum() or c == "+" else c for c in value) + "".join(chars)
    if kind == "email":
        name, domain = value.rpartition("@")[0], value.rpartition("@")[2]
        new, new_domain = norm.rpartition("@")[0], norm.rpartition("@")[2]
        return f"{_cased(name, new)}@{_cased(domain, new_domain)}"
    if kind == "ipv6":
        norm = ipaddress.IPv6Address(norm).exploded if len(value) == 39 else norm
        return norm.upper() if value.upper() == value else norm
    return norm


def surrogate(kind: str, gender: str, value: str, key: bytes, rounds: dict[tuple[str, str], int]) -> str:
    """What replaces the occurrence ``value``."""
    new = {k: replaced(k, n, rounds.get((k, n), 0), key) for k, n in named(kind, gender, value)}
    if kind == "email":
        return shaped(kind, value, new["email"].rpartition("@")[0] + "@" + new["domain"])
    if kind == "person":
        places = list(TOKEN.finditer(value))
        given = new["person"].split(" ")[:-1] if "person" in new else [m[0] for m in places[:-1]]
        out, at = [], 0
        for m, word in zip(places, [*given, new["surname"]], strict=True):
            out += [value[at : m.start()], m[0] if m[0] in PARTICLES else _named_like(m[0], word)]
            at = m.end()
        return "".join(out)
    return shaped(kind, value, new[kind])


def _cased(value: str, new: str) -> str:
    """``new`` with the capitals of ``value``; what is longer stays."""
    return "".join(n.upper() if v.isupper() and len(n.upper()) == 1 else n for v, n in zip(value, new)) + new[len(value) :]


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct (kind, norm) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            seen = set()
            for text in batch.column("t").to_pylist():
                for a, b, kind, gender in find(text or ""):
                    seen.update(named(kind, gender, text[a:b]))
            own = sorted(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in own], pa.string()), pa.array([x for _, x in own], pa.string())],
                ["kind", "norm"],
            )

    return docs.select(docs[text_col].alias("t")).mapInArrow(run, "kind string, norm string").distinct()


def _drawn(ents: DataFrame, key: bytes) -> DataFrame:
    def run(batches):
        for batch in batches:
            cols = batch.to_pydict()
            new = [replaced(*x, key) for x in zip(cols["kind"], cols["norm"], cols["round"], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], ["kind", "norm", "round", "new"])

    return ents.select("kind", "norm", "round").mapInArrow(run, "kind string, norm string, round int, new string")


def collision_free(ents: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """(kind, norm, round, new) with ``new`` unique in its kind and no real entity.

    ``new`` is a person's given name with the real surname, an e-mail's local part
    with the real domain; see ``replaced``.

    Of several entities that draw the same surrogate the first keeps it.  The
    values to draw from grow with the round, so the rounds end.
    """
    visible = F.when(F.col("kind") == "person", F.regexp_replace("norm", "^[mf]?:", "")).otherwise(F.col("norm"))
    real = ents.select("kind", visible.alias("new"))
    # Each round draws for the entities that failed only, and compares with all earlier
    # draws: a value that was given up is still held by the entity that won it.
    fresh = stored(_drawn(ents.withColumn("round", F.lit(0)), key))
    earlier, settled = None, None
    while True:
        first = fresh.groupBy("kind", "new").agg(F.min("norm").alias("owner"), F.count("*").alias("n")).where("n > 1")
        clash = (
            fresh.join(first, ["kind", "new"])
            .where("norm != owner")
            .select("kind", "norm", "round")
            .unionByName(fresh.join(real, ["kind", "new"], "left_semi").select("kind", "norm", "round"))
        )
        if earlier is not None:
            clash = clash.unionByName(fresh.join(earlier, ["kind", "new"], "left_semi").select("kind", "norm", "round"))
        clash = stored(clash.distinct())
        kept = fresh.join(clash, ["kind", "norm"], "left_anti")
        settled = kept if settled is None else settled.unionByName(kept)
        if clash.isEmpty():
            return settled
        values = fresh.select("kind", "new")
        earlier = values if earlier is None else earlier.unionByName(values)
        fresh = stored(_drawn(clash.withColumn("round", F.col("round") + 1), key))


def replace_text(text: str, key: bytes, rounds: dict[tuple[str, str], int]) -> tuple[str, list[tuple[int, int, str]]]:
    out, spans, at = [], [], 0
    size = 0
    for a, b, kind, gender in find(text):
        new = surrogate(kind, gender, text[a:b], key, rounds)
        out += [text[at:a], new]
        size += a - at
        spans.append((size, size + len(new), kind))
        size += len(new)
        at = b
    return "".join(out) + text[at:], spans


def anonymise(
    docs: DataFrame, key: bytes = DEFAULT_KEY, id_col: str = "doc_id", text_col: str = "text", limit: int = EXCEPTION_ROWS
) -> DataFrame:
    """(doc_id, text, spans): every whole text with its entities replaced.

    ``spans`` lists first, end (characters of the new text) and kind of each
    surrogate.  One row per input row.  A null text stays null, an empty one empty,
    both without spans; equal rows give equal results.  Only the named columns
    are read.

    Surrogates are computed where they are used.  Only entities that had to draw
    again are looked up: from a table sent to all tasks while it has at most
    ``limit`` rows, else from a join with the documents that hold them.
    """
    src = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"))
    kind = src.schema["i"].dataType.simpleString()
    again = collision_free(stored(entities(docs, text_col)), key).where("round > 0").select("kind", "norm", "round")
    few = again.limit(limit + 1).collect()
    rounds = {(r["kind"], r["norm"]): r["round"] for r in few}
    if len(few) <= limit:
        src = src.withColumn("r", F.expr("cast(null as map<string,int>)"))
    else:
        rounds = {}
        src = _with_rounds(src, again)
    shared = docs.sparkSession.sparkContext.broadcast(rounds)

    def run(batches):
        common = shared.value
        for batch in batches:
            for piece in pieces(batch, "t"):
                texts, spans = [], []
                for text, own in zip(piece.column("t").to_pylist(), piece.column("r").to_pylist(), strict=True):
                    if text is None:
                        texts.append(None)
                        spans.append([])
                        continue
                    extra = {tuple(k.split("\x1f", 1)): n for k, n in own} if own else common
                    new, where = replace_text(text, key, extra)
                    texts.append(new)
                    spans.append([{"first": a, "end": b, "kind": k} for a, b, k in where])
                span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("i"), pa.array(texts, pa.string()), pa.array(spans, span)], ["doc_id", "text", "spans"]
                )

    return src.mapInArrow(
        run, f"doc_id {kind}, text string, spans array<struct<first:long,end:long,kind:string>>"
    )


def _with_rounds(src: DataFrame, again: DataFrame) -> DataFrame:
    """Adds to each row a map of the redrawn entities in its text."""

    def run(batches):
        for batch in batches:
            rows = set()
            for h, text in zip(batch.column("h").to_pylist(), batch.column("t").to_pylist(), strict=True):
                for a, b, kind, gender in find(text or ""):
                    rows.update((h, k, norm) for k, norm in named(kind, gender, text[a:b]))
            cols = list(zip(*sorted(rows), strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["h", "kind", "norm"])

    hashed = src.withColumn("h", F.sha2(F.coalesce("t", F.lit("")), 256))
    held = (
        hashed.select("h", "t").mapInArrow(run, "h string, kind string, norm string").distinct()
        .join(again, ["kind", "norm"])
        .groupBy("h")
        .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "norm"), "round"))).alias("r"))
    )
    return hashed.join(held, "h", "left").select("i", "t", "r")
