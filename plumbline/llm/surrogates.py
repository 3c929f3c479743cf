"""Personal data replaced by keyed, type-consistent surrogates.

Detected by form: e-mail addresses, IPv4 and IPv6 addresses, phone numbers (international, grouped as in North
America, or any digits after a word such as ``Tel.``), card numbers and IBANs whose check digits are right, social
security numbers, long hexadecimal tokens, values of ``token = ...`` and the like.

Detected by context, persons' names in any script: after a form of address (``Dr. X``), after or before a cue
(``my name is X Y``, ``X Y wrote``), a common given name with what follows it (middle names, initials, particles,
surname; in capitals too), a capitalised word before a common surname, and both common in small letters. Once a
document has named a person, its other mentions of that given name or surname count as well.

A surrogate is a keyed permutation of its entity's symbols within their classes: digits for digits, vowels
for vowels and consonants for consonants of the same script, upper case for upper case, separators as they
were. Letters beyond the listed classes are permuted among the letters of their kind in the same 128 code points.
Check digits of cards and IBANs stay right, country codes stay, octets stay octets, a common given name becomes
another one of the same gender and script, and endings that tell a surname's gender stay. So

- distinct entities of a form have distinct surrogates, since a permutation is one-to-one;
- an entity has the same surrogate everywhere (coreference): the permutation works on its canonical form (digits
  only, small letters, phone numbers with their country), which is then written as the mention was;
- no entity keeps its value: the permutation is a keyed shift seen through a Feistel cipher, E^-1(E(x) + 1),
  which has no fixed points. A mention with nothing to permute is counted as not replaced.

Both properties are checked over all documents: digests of entities and surrogates are written with the new texts
in the one scan and grouped by surrogate (two entities?) and by entity (two surrogates?). An entity that fails is
permuted by another round of the key, and the scan is made again with these few (at most ``max_rounds``) exceptions.
Digests are keyed; no entity leaves its task in clear.

Defined results: null texts stay null, texts without entities stay as they are, whole. Repeated rows stay. An
empty table gives no rows. Other columns are kept. The key is a parameter that callers should keep secret.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import forget, slices
from plumbline.sources.scratch import materialize, release

#: Classes of letters that stand for each other.
LETTERS = (
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "áàâäãåæéèêëíìîïóòôöõøúùûü",
    "çñðþ",
    "аеёиоуыэюя",
    "бвгджзйклмнпрстфхцчшщъь",
    "αεηιουω",
    "βγδζθκλμνξπρστφχψ",
)
#: Common given names by gender and script.
GIVEN_NAMES = {
    "female Latin": ("Aisha", "Alice", "Anna", "Barbara", "Carmen", "Catherine", "Claire", "Elena", "Elizabeth", "Emily", "Emma", "Eva", "Fatima", "Ingrid", "Isabel", "Jessica", "Julia", "Katarzyna", "Laura", "Linda", "Lucía", "Margaret", "Maria", "María", "Marie", "Martha", "Mary", "Mei", "Monika", "Nicole", "Olga", "Olivia", "Patricia", "Petra", "Priya", "Sabine", "Sarah", "Sofía", "Sophie", "Susan", "Ursula", "Yuki"),
    "male Latin": ("Ahmed", "Alexander", "Andreas", "Antonio", "Carlos", "Charles", "Christopher", "Daniel", "David", "Diego", "François", "Frank", "George", "Hans", "Henry", "Hiroshi", "Ivan", "Jacques", "James", "Javier", "Jean", "John", "José", "Jürgen", "Klaus", "Louis", "Luis", "Manuel", "Michael", "Miguel", "Mohammed", "Paul", "Pedro", "Peter", "Pierre", "Rajesh", "Robert", "Stefan", "Thomas", "William", "Łukasz"),
    "female Cyrillic": ("Анна", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"),
    "male Cyrillic": ("Александр", "Алексей", "Андрей", "Дмитрий", "Иван", "Михаил", "Сергей", "Николай"),
    "female Greek": ("Ελένη", "Κατερίνα", "Μαρία", "Σοφία"),
    "male Greek": ("Γιώργος", "Δημήτρης", "Κώστας", "Νίκος"),
}
#: Common surnames.
SURNAMES = (
    "Ali", "Andersson", "Brown", "Chen", "Davis", "Dubois", "Fernández", "Fischer", "García", "Garcia", "Gonzalez", "González", "Gupta", "Hernandez", "Hussain", "Ivanov", "Ivanova", "Jensen", "Johansson", "Johnson", "Jones", "Khan", "Kim", "Kowalski", "Kumar", "Lopez", "López", "Martin", "Martinez", "Meyer", "Miller", "Moreau", "Müller", "Nguyen", "Nowak", "Papadopoulos", "Patel", "Perez", "Pérez", "Petrov", "Petrova", "Rodriguez", "Rossi", "Sato", "Schmidt", "Schneider", "Sharma", "Silva", "Singh", "Smith", "Smirnova", "Suzuki", "Tanaka", "Taylor", "Tran", "Wagner", "Wang", "Weber", "Williams", "Wilson", "Yamamoto", "Zhang",
)
#: Endings of surnames that tell a gender.
ENDINGS = ("ova", "eva", "ina", "ská", "ska", "ова", "ева", "ина", "ская")
#: Forms of address before a name.
ADDRESSES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Mademoiselle", "Señor", "Señora", "Sr", "Sra", "MR", "MRS", "MS", "DR", "PROF", "HERR", "FRAU", "господин", "госпожа", "Господин", "Госпожа")
#: What comes before a name, by the word that makes a text worth a closer look; and verbs after one.
CUES = {"name": r"my name is|name:|mein name ist", "named": "named", "author": "author:", "signed": "signed,?", "contact": "contact(?: person)?:", "heiße": "ich heiße", "appelle": "je m'appelle", "nombre": "mi nombre es", "llamo": "me llamo", "зовут": "меня зовут"}
SPEECH = ("said", "says", "wrote", "writes", "replied", "asked", "told", "sagte", "schrieb", "écrit", "dijo", "escribió")
#: Parts of a surname in small letters, and words that start a sentence but no name.
PARTICLES = ("von", "van", "de", "del", "della", "da", "di", "la", "le", "bin", "ibn", "al", "der", "den", "ter", "zu", "y")
NO_NAMES = ("The", "A", "An", "This", "That", "In", "On", "At", "Der", "Die", "Das", "Ein", "Eine", "Le", "La", "Les", "Un", "Une", "El", "Los", "Las", "Una", "And", "But", "Und", "Et", "Y", "He", "She", "It", "We", "They", "I", "As", "For", "Of", "To", "By", "With", "When", "Then", "While", "New", "North", "South", "East", "West", "San", "Saint", "United", "University")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Forms of entities, tried in this order at each place.
FORMS = {
    "email": r"(?<![\w.%+\-])[\w.%+\-]++(?<=\w)@\w[\w\-]*+(?:\.\w[\w\-]*+)+",
    "secret": r"(?i:(?<=token)|(?<=key)|(?<=secret)|(?<=password)|(?<=passwd)|(?<=pwd))[\"']?\s*[:=]\s*[\"']?(?P<value>[A-Za-z0-9_+/=.\-]{8,})",
    "hex": r"\b(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b",
    "ip6": r"(?<![\w:.])(?=[0-9a-fA-F:]*:[0-9a-fA-F:]*:)[0-9a-fA-F:]{2,39}(?![\w:.]\w)",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "phone": r"(?<![\d+])(?:(?:\+|\b00(?=[1-9]))\d{1,3}[ .\-]?(?:\(0\)[ .\-]?)?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-/]?\d{2,4}){2,4}|\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}|(?i:(?<=\bphone)|(?<=\btel)|(?<=\bmobile)|(?<=\bfax)|(?<=\btéléphone)|(?<=\bteléfono)|(?<=\btelefon))[.:]?[.:]? ?(?P<bare>\(?\d(?:[ .\-/()]{0,2}\d){6,14}))(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)",
}
_FOUND = re.compile("|".join(f"(?P<{k}>{v})" for k, v in FORMS.items()))
_TRIGGER = re.compile(r"[0-9@]|(?i:password|passwd|secret|token|pwd|key)[\"']?\s*[:=]")
_WORD = re.compile(r"[^\W\d_]+")
_CLASS = {c: (letters, letters.index(c)) for letters in LETTERS for c in letters}
_BLOCK = 40

_GAP = r"(?:[ \t\xa0]+|[ \t]*\n[ \t]*)"
_CAPITAL = r"(?:\p{Lu}[\p{L}\p{M}]*(?:['’\-]\p{L}[\p{L}\p{M}]*)*)"
_REST = rf"(?:{_GAP}(?:\p{{Lu}}\.(?!\p{{L}})|(?:(?:{'|'.join(PARTICLES)}){_GAP}){{1,2}}{_CAPITAL}|{_CAPITAL}))"
_UNCASED = r"[\p{Lo}][\p{Lo}\p{M}]*"
_START = r"(?<![\p{L}\p{M}])"
_END = r"(?![\p{L}\p{M}])"
_both = lambda names: [*names, *(n.upper() for n in names)]
_GIVEN = [n for names in GIVEN_NAMES.values() for n in names]
_NAMES = tuple(
    regex.compile(p, given=_both(_GIVEN), surname=_both(SURNAMES), little_given=[n.lower() for n in _GIVEN], little_surname=[n.lower() for n in SURNAMES], address=list(ADDRESSES), no=list(NO_NAMES), verb=list(SPEECH), ignore_unused=True)
    for p in (
        rf"{_START}\L<address>\.?{_GAP}(?P<n>{_CAPITAL}{_REST}{{0,2}}|{_UNCASED}(?:[ ·]{_UNCASED}){{0,2}})",
        rf"{_START}(?i:{'|'.join(CUES.values())}){_GAP}(?P<n>{_CAPITAL}{_REST}{{1,3}}|\L<little_given>{_GAP}\p{{Ll}}[\p{{L}}\p{{M}}]+|{_UNCASED}(?:[ ·]{_UNCASED}){{0,2}})",
        rf"{_START}(?P<n>\L<given>{_REST}{{1,3}})",
        rf"{_START}(?!\L<no>{_END})(?P<n>{_CAPITAL}(?:{_GAP}\p{{Lu}}\.)?{_GAP}\L<surname>){_END}",
        rf"{_START}(?P<n>\L<little_given>{_GAP}\L<little_surname>){_END}",
        rf"{_START}(?<!\p{{Lu}}[\p{{L}}\p{{M}}]*[ ])(?!\L<no>{_END})(?P<n>{_CAPITAL}{_REST}{{1,2}}){_GAP}\L<verb>{_END}",
    )
)
_HINTS = frozenset([*_both(_GIVEN), *(n.lower() for n in _GIVEN), *_both(SURNAMES), *ADDRESSES, *CUES, *(c.capitalize() for c in CUES), *SPEECH])
_GROUP_OF = {n.lower(): (group, names) for group, names in GIVEN_NAMES.items() for n in names}


@lru_cache(maxsize=4096)
def letter_class(low: str) -> tuple[str, int] | None:
    """The letters that may stand for a (small) letter and its place among them; None if there is no other."""
    if low in _CLASS:
        return _CLASS[low]
    if ord(low) < 128 or not low.isalpha():
        return None
    kind, first = unicodedata.category(low), ord(low) // 128 * 128

    def fits(c: str) -> bool:
        up = c.upper()
        return c not in _CLASS and ord(c) > 127 and unicodedata.category(c) == kind and c.lower() == c and len(up) == 1 and up.lower() == c and unicodedata.normalize("NFC", c) == c

    letters = "".join(filter(fits, map(chr, range(first, first + 128))))
    return (letters, letters.index(low)) if low in letters and len(letters) > 1 else None


def country_code(digits: str) -> str:
    """The calling code that an international number starts with: one digit for zones 1 and 7, two or three else."""
    #: Calling codes of two digits.
    two = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
    return digits[:1] if digits[:1] in "17" else digits[:2] if digits[:2] in two else digits[:3]


def parse_phone(text: str) -> tuple[str, list[int]]:
    """Country code ('' if unknown) and the places of the national number's digits. ``(0)`` is no part of it."""
    trunk = text.find("(0)")
    places = [i for i, c in enumerate(text) if "0" <= c <= "9" and not (trunk >= 0 and trunk <= i < trunk + 3)]
    digits = "".join(text[i] for i in places)
    if "+" in text or digits.startswith("00"):
        skip = 0 if "+" in text else 2
        code = country_code(digits[skip:])
        return code, places[skip + len(code) :]
    if len(digits) == 11 and digits[0] == "1":
        return "1", places[1:]
    return ("1" if len(digits) == 10 and digits[0] != "0" else ""), places


def luhn(digits: list[int]) -> int:
    """The check digit after these digits."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def iban_check(country: str, body: str) -> str:
    """The two check digits of an IBAN."""
    number = "".join(str(int(c, 36)) for c in body.replace(" ", "") + country)
    return f"{98 - int(number + '00') % 97:02d}"


def holds(kind: str, text: str) -> bool:
    """Whether what has an entity's form passes the checks that its kind has."""
    if kind == "card":
        digits = [int(c) for c in text if c.isdigit()]
        return luhn(digits[:-1]) == digits[-1]
    if kind == "iban":
        return iban_check(text[:2], text[4:]) == text[2:4]
    if kind == "ip6":
        try:
            return int(ipaddress.IPv6Address(text)) > 1
        except ValueError:
            return False
    return True


def canonical(kind: str, text: str) -> str:
    """What all mentions of one entity have in common."""
    if kind == "phone":
        code, places = parse_phone(text)
        return f"{'+' if code else ''}{code} {''.join(text[i] for i in places)}"
    if kind in ("card", "ssn"):
        return "".join(c for c in text if c.isdigit())
    if kind == "ip6":
        return ipaddress.IPv6Address(text).exploded
    return text if kind == "secret" else text.replace(" ", "").lower()


def cased_like(new: str, old: str) -> str:
    """new in capitals, small letters or with a first capital, as old is."""
    if old.isupper() and len(old) > 1:
        return new.upper()
    return new.lower() if old.islower() else new


class Surrogates:
    """Surrogates under one key. rounds: by digest of an entity, which further round of the key it takes."""

    def __init__(self, key: bytes, rounds: Mapping[str, int] | None = None) -> None:
        self.key = blake2b(key, digest_size=32).digest()
        self.rounds = dict(rounds or {})
        self.of = lru_cache(maxsize=20_000)(self._of)
        self.name_of = lru_cache(maxsize=20_000)(self._name_of)

    def seal(self, kind: str, text: str) -> str:
        """A keyed digest of a canonical form."""
        return blake2b(f"{kind}\0{text}".encode(), key=self.key, digest_size=16).hexdigest()

    def _tweak(self, kind: str, entity: str, tweak: str) -> str:
        turn = self.rounds.get(self.seal(kind, entity), 0) if self.rounds else 0
        return f"{tweak} again {turn}" if turn else tweak

    def _round(self, value: int, tweak: bytes, n: int, mask: int) -> int:
        digest = blake2b(tweak + bytes([n]) + value.to_bytes((value.bit_length() + 7) // 8, "little"), key=self.key)
        return int.from_bytes(digest.digest(), "little") & mask

    def _cipher(self, x: int, size: int, tweak: bytes, back: bool = False) -> int:
        """A keyed permutation of range(size): a balanced Feistel network, repeated while it leaves the range."""
        half = ((size - 1).bit_length() + 1) // 2 or 1
        mask = (1 << half) - 1
        while True:
            left, right = x >> half, x & mask
            for n in range(9, -1, -1) if back else range(10):
                if back:
                    left, right = right ^ self._round(left, tweak, n, mask), left
                else:
                    left, right = right, left ^ self._round(right, tweak, n, mask)
            x = left << half | right
            if x < size:
                return x

    def permute(self, values: list[int], sizes: list[int], tweak: str) -> list[int]:
        """values, each below its size, permuted without fixed points (where a size is over 1)."""
        out: list[int] = []
        for at in range(0, len(values), _BLOCK):
            block, own = values[at : at + _BLOCK], sizes[at : at + _BLOCK]
            x, size = 0, 1
            for v, s in zip(block, own, strict=True):
                x, size = x * s + v, size * s
            if size > 1:
                mark = f"{tweak} {at} {size} ".encode()
                x = self._cipher((self._cipher(x, size, mark) + 1) % size, size, mark, back=True)
            got = []
            for s in reversed(own):
                x, v = divmod(x, s)
                got.append(v)
            out += reversed(got)
        return out

    def spelled(self, text: str, tweak: str) -> str:
        """Digits and letters of text permuted in their classes; all else stays."""
        values, sizes, made = [], [], []
        for c in text:
            low = c.lower()
            letters, place = ("0123456789", ord(c) - 48) if c in "0123456789" else letter_class(low) or (None, 0) if len(low) == 1 else (None, 0)
            made.append((letters, c != low))
            if letters:
                values.append(place)
                sizes.append(len(letters))
        got = iter(self.permute(values, sizes, tweak))
        return "".join(c if not letters else letters[next(got)].upper() if upper else letters[next(got)] for c, (letters, upper) in zip(text, made, strict=True))

    def digits(self, old: list[int], tweak: str, last: Callable[[list[int]], int] | None = None) -> list[int]:
        """Digits permuted; the first of them stays in 0-1 or 2-9. last: the check digit of the digits before it."""
        body = old[:-1] if last else old
        if not body:
            return old
        low = 2 if body[0] >= 2 else 0
        new = self.permute([body[0] - low, *body[1:]], [(8 if low else 2), *[10] * (len(body) - 1)], tweak)
        new[0] += low
        return [*new, last(new)] if last else new

    def _of(self, kind: str, text: str) -> str:
        tweak = self._tweak(kind, canonical(kind, text), kind)
        if kind == "email":
            local, _, domain = text.rpartition("@")
            name, dot, top = domain.rpartition(".")
            return f"{self.spelled(local, tweak + ' local')}@{self.spelled(name, tweak + ' domain')}{dot}{top}"
        if kind == "ip":
            return ".".join(map(str, self.permute([int(o) for o in text.split(".")], [256] * 4, tweak)))
        if kind == "ip6":
            groups = [int(g, 16) for g in canonical(kind, text).split(":")]
            #: Zero groups stay, so that what is left out by :: can be left out again.
            new = iter(self.permute([g - 1 for g in groups if g], [65_535] * sum(map(bool, groups)), tweak))
            made = ipaddress.IPv6Address(":".join(f"{next(new) + 1 if g else 0:x}" for g in groups))
            out = str(made) if "::" in text else ":".join(f"{int(g, 16):0{len(o)}x}" for g, o in zip(made.exploded.split(":"), text.split(":"), strict=True))
            return out.upper() if text.upper() == text else out
        if kind in ("phone", "card", "ssn"):
            code, places = parse_phone(text) if kind == "phone" else ("", [i for i, c in enumerate(text) if c.isdigit()])
            new = self.digits([int(text[i]) for i in places], f"{tweak} {code}", luhn if kind == "card" else None)
            out = list(text)
            for i, d in zip(places, new, strict=True):
                out[i] = str(d)
            return "".join(out)
        if kind == "hex" or kind == "secret" and re.fullmatch("[0-9a-f]+|[0-9A-F]+", text):
            new = "".join(f"{v:x}" for v in self.permute([int(c, 16) for c in text], [16] * len(text), f"{tweak} hex"))
            return new.upper() if text.upper() == text else new
        if kind == "iban":
            plain = text.replace(" ", "")
            body = self.spelled(plain[4:], f"{tweak} {text[:2]}")
            got = iter(text[:2] + iban_check(text[:2], body) + body)
            return "".join(c if c == " " else next(got) for c in text)
        return self.spelled(text, tweak)

    def _name_of(self, token: str) -> str:
        """A name's surrogate in small letters (a common given name's as it is listed). token: in small letters."""
        tweak = self._tweak("name", token, "name")
        if token in _GROUP_OF:
            group, names = _GROUP_OF[token]
            place = next(i for i, n in enumerate(names) if n.lower() == token)
            return names[self.permute([place], [len(names)], f"{tweak} {group}")[0]]
        ending = next((e for e in ENDINGS if token.endswith(e) and len(token) > len(e) + 1), "")
        stem = token[: len(token) - len(ending)]
        new = stem
        #: What is no common given name and has no such ending stays so; walking on keeps the map one-to-one.
        while True:
            new = self.spelled(new, f"{tweak} {ending}")
            if new == stem or new + ending not in _GROUP_OF and (ending or not new.endswith(ENDINGS)):
                return new + ending

    def person(self, text: str) -> tuple[str, list[tuple[str, str]]]:
        """A mention of a person with surrogates for its names, and (name, surrogate) of each, in small letters."""
        made = []

        def put(match: regex.Match) -> str:
            token = match[0]
            if token in PARTICLES:
                return token
            new = self.name_of(token.lower())
            made.append((token.lower(), new.lower()))
            if token.lower() in _GROUP_OF:
                return cased_like(new, token)
            return "".join(n.upper() if o != o.lower() else n for n, o in zip(new, token, strict=True)) if len(token) == len(new) else cased_like(new, token)

        return _TOKEN.sub(put, text), made

    def replace(self, text: str) -> tuple[str, list[tuple[str, str, str]]]:
        """The text with surrogates, and (kind, entity, surrogate) of each mention, canonical; equal if it could not change."""
        spans: list[tuple[int, int, str]] = []
        made: list[tuple[str, str, str]] = []
        if _TRIGGER.search(text):
            for match in _FOUND.finditer(text):
                kind, (start, end) = match.lastgroup, match.span()
                if match["value"]:
                    kind, (start, end) = "secret", match.span("value")
                elif match["bare"]:
                    kind, (start, end) = "phone", match.span("bare")
                old = text[start:end]
                if holds(kind, old):
                    new = self.of(kind, old)
                    spans.append((start, end, new))
                    made.append((kind, canonical(kind, old), canonical(kind, new)))
        if not _HINTS.isdisjoint(_WORD.findall(text)):
            self._replace_names(text, spans, made)
        if not spans:
            return text, made
        out, at = [], 0
        for start, end, new in sorted(spans):
            out += text[at:start], new
            at = end
        return "".join([*out, text[at:]]), made

    def _replace_names(self, text: str, spans: list[tuple[int, int, str]], made: list[tuple[str, str, str]]) -> None:
        taken = bytearray(len(text))
        for start, end, _ in spans:
            taken[start:end] = b"\1" * (end - start)
        known: set[str] = set()

        def take(start: int, end: int) -> None:
            if any(taken[start:end]):
                return
            taken[start:end] = b"\1" * (end - start)
            new, names = self.person(text[start:end])
            spans.append((start, end, new))
            made.extend(("name", a, b) for a, b in names)
            known.update(a for a, _ in names if len(a) > 2)

        for pattern in _NAMES:
            for match in pattern.finditer(text):
                take(*match.span("n"))
        if known:
            for match in _TOKEN.finditer(text):
                if match[0] != match[0].lower() and match[0].lower() in known:
                    take(*match.span())


_TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}]*")


@lru_cache(maxsize=4)
def surrogates(key: bytes, rounds: tuple[tuple[str, int], ...] = ()) -> Surrogates:
    """This process's surrogates for a key."""
    return Surrogates(key, dict(rounds))


def with_surrogates(docs: DataFrame, key: bytes, rounds: Mapping[str, int], made: str) -> DataFrame:
    """docs with surrogates in column text, and a column ``made``: digests (entity, surrogate) of what was replaced."""
    place = docs.columns.index("text")
    turns = tuple(sorted(rounds.items()))
    kind = pa.list_(pa.struct([("entity", pa.string()), ("surrogate", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        use = surrogates(key, turns)
        for batch in slices(batches, 512):
            done = [(None, []) if t is None else use.replace(t) for t in batch.column(place).to_pylist()]
            columns = [pa.array([d[0] for d in done], pa.string()) if i == place else c for i, c in enumerate(batch.columns)]
            sealed = [[{"entity": use.seal(k, a), "surrogate": use.seal(k, b)} for k, a, b in d[1]] for d in done]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sealed, kind)], [*batch.schema.names, made])

    schema = docs.select("*", F.lit(None).cast("array<struct<entity:string,surrogate:string>>").alias(made)).schema
    return docs.mapInArrow(run, schema)


def failing_entities(done: DataFrame, made: str) -> DataFrame:
    """entity (digest): all but the first of those that share a surrogate, and any with two surrogates.

    Mentions that could not change are left out: their surrogate is the entity itself.
    """
    pairs = done.select(F.explode(made).alias("m")).select("m.*").filter("entity <> surrogate").distinct()
    least = pairs.groupBy("surrogate").agg(F.min("entity").alias("least"), F.count("*").alias("n")).filter("n > 1")
    shared = pairs.join(least, "surrogate").filter("entity <> least").select("entity")
    split = pairs.groupBy("entity").agg(F.count("*").alias("n")).filter("n > 1").select("entity")
    return shared.unionByName(split).distinct()


def replace_pii(docs: DataFrame, key: bytes, counts: bool = False, max_rounds: int = 100_000) -> DataFrame:
    """docs with surrogates in column text; with counts, n_replaced and n_unchanged are added.

    One scan writes texts and digests; only if the check fails it is made again with the failing entities' rounds.
    """
    made = "__made"
    while made in docs.columns:
        made += "_"
    rounds: dict[str, int] = {}
    while True:
        done = materialize(with_surrogates(docs, key, rounds, made), "surrogates")
        failing = [r.entity for r in failing_entities(done, made).limit(max_rounds + 1).collect()]
        if not failing:
            break
        release(done)
        rounds |= {e: rounds.get(e, 0) + 1 for e in failing}
        if len(rounds) > max_rounds:
            raise ValueError(f"over {max_rounds} entities meet others; choose another key")
    if not counts:
        return done.drop(made)
    same = F.size(F.filter(made, lambda m: m["entity"] == m["surrogate"])).cast("long")
    return done.withColumns({"n_unchanged": same, "n_replaced": F.size(made).cast("long") - same}).drop(made)
