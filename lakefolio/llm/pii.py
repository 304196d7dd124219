"""Personal data replaced by keyed, type-consistent surrogates.

A surrogate keeps the format of what it replaces: every letter and digit of any
script goes to one of its class (digit, hexadecimal digit, vowel, consonant,
accented letter; of its script and case), literal characters stay, a card number that passes the Luhn
test passes it again (other long numbers are no cards and stay), an IBAN keeps
its country and gets right check digits, an IP address of a private or reserved
network stays in that network, a MAC address keeps its maker, a key keeps the
prefix that tells its kind, a given name of the list becomes one of the same
gender and script.

Detection is linear in the text, whatever it holds: every pattern begins at a
boundary and has bounded or possessive parts, an address is read from its @
outwards, and mentions of found persons are looked up token by token.

Within a type and format the mapping is a keyed permutation without fixed
points: g^-1(g(x) + 1), g a Feistel network on the numbers that the format can
write, all on one cycle. Values that fail the type's own check are walked over,
which keeps it a permutation of the values that pass. So the same entity gets
the same surrogate in every document (coreference), different entities of a
format get different ones, and entities of different formats differ by format:
no table of entities is needed, whatever the corpus size. What can be written in
several ways is permuted in one canonical form and written as it was found: a
phone number by its digits and country, a card number and an IBAN without
separators. Two checks stand behind that: in a document an entity whose
surrogate is taken walks on along the cycle, and `collisions` finds surrogates
that two entities of a corpus share (none).
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import string
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from math import isqrt, prod

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

# Letters that are replaced by each other.
_CLASSES = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöùúûüýÿ", "ñçßæœøšžčćđłńśźż",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщьъ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ",
)
# Given names by gender and script.
_NAMES = {
    ("m", "latin"): "james john robert michael william david richard thomas hans peter klaus jürgen pierre jean michel françois carlos josé juan luis".split(),
    ("f", "latin"): "mary patricia jennifer linda elizabeth barbara susan sarah anna ursula monika sabine marie claire sophie hélène maría carmen lucía elena".split(),
    ("m", "cyrillic"): "иван пётр сергей алексей дмитрий николай михаил андрей".split(),
    ("f", "cyrillic"): "анна мария ольга елена наталья татьяна ирина светлана".split(),
    ("m", "greek"): "γιώργος νίκος δημήτρης κώστας παναγιώτης".split(),
    ("f", "greek"): "μαρία ελένη κατερίνα σοφία γεωργία".split(),
}
_TITLES = {"m": "Mr|Mister|Herr|Herrn|Monsieur|Señor|Sr|Господин|Κύριος", "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Señora|Sra|Госпожа|Κυρία"}

# Private and reserved networks.
_NETWORKS = [ipaddress.ip_network(n) for n in "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.168.0.0/16 224.0.0.0/4 240.0.0.0/4".split()]
_HEX = "0123456789abcdef"
_OF_CLASS = {c: (n, i) for n, some in enumerate(_CLASSES) for i, c in enumerate(some)}
# Telephone country codes of one and two digits; all others have three.
_COUNTRIES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_PLACE = r"(?<![\p{L}\p{N}_])"
# Particles of names.
_PARTICLES = "al|af|av|bin|da|de|del|della|den|der|des|di|do|dos|du|el|ibn|la|las|le|los|ten|ter|van|von|zu|zum|zur"
_SMALL = frozenset(_PARTICLES.split("|"))
_PART = r"(?:\p{Lu}[\p{L}\p{M}]{1,39}+|\p{Lu}(?=['’]))(?:['’-](?!s(?![\p{L}\p{M}]))\p{L}[\p{L}\p{M}]{0,39}+){0,3}+(?![\p{L}\p{M}])"
_NAME = rf"(?:(?:{_PARTICLES})[ ]){{0,3}}+{_PART}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_SECRETS = r"(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\s*+[=:]"
#: Prefixes that tell what a key is of: they stay.
_KEYS = r"AKIA(?=[0-9A-Z]{16}\b)|gh[pousr]_(?=[A-Za-z0-9]{20})|sk-(?=[A-Za-z0-9_-]{20})|xox[abprs]-(?=[A-Za-z0-9-]{10})|AIza(?=[0-9A-Za-z_-]{30})|[Bb]earer[ ](?=[A-Za-z0-9._~+/-]{16})|eyJ(?=[A-Za-z0-9_-]{8,512}\.eyJ)"
_FIND_SECRETS = regex.compile(
    rf"""{_SECRETS}\s*+["']?(?P<secret>[A-Za-z0-9+/_-]{{16,}}+)
    |(?i:password|passwd|pwd)\s*+[=:]\s*+["']?(?P<password>(?=[^\s0-9]{{0,15}}[0-9])[A-Za-z0-9+/_!\#$%&*.-]{{6,15}}+)
    |(?<![\p{{L}}\p{{N}}_-])(?:{_KEYS})(?P<api_key>[A-Za-z0-9._~+/-]++)""",
    regex.VERBOSE,
)
_FIND_NUMBERS = regex.compile(
    rf"""(?P<iban>{_PLACE}[A-Z]{{2}}[0-9]{{2}}(?:\ ?[A-Z0-9]{{4}}){{2,7}}(?:\ ?[A-Z0-9]{{1,3}})?(?![\p{{L}}\p{{N}}]))
    |(?P<mac>(?<![\p{{L}}\p{{N}}_:-])[0-9A-Fa-f]{{2}}(?P<dash>[:-])[0-9A-Fa-f]{{2}}(?:(?P=dash)[0-9A-Fa-f]{{2}}){{4}}(?![\p{{L}}\p{{N}}_:-]))
    |(?P<ip6>(?<![\p{{L}}\p{{N}}_:.])(?=[0-9A-Fa-f]{{0,4}}:)[0-9A-Fa-f:]{{8,39}}+(?![\p{{L}}\p{{N}}_:]))
    |(?P<phone>(?<![\p{{L}}\p{{N}}])\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9]{{2,5}}(?:[ .-]?[0-9]{{2,5}}){{1,4}}(?![0-9])
      |(?<![0-9])\([0-9]{{3}}\)\ ?[0-9]{{3}}-[0-9]{{4}}(?![0-9])
      |(?<![\p{{L}}\p{{N}}_])(?<![0-9][ .,/-])(?:1[ .-])?[0-9]{{3}}(?P<between>[ .-])[0-9]{{3}}(?P=between)[0-9]{{4}}(?![\p{{L}}\p{{N}}_]|[ .,/-][0-9]))
    |(?P<ssn>(?<![0-9-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9-]))
    |(?P<ip>(?<![0-9])(?<![0-9]\.)(?<!(?i:version|release|firmware|build)[ :]{{1,2}}|\b[vV]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9]))
    |(?P<card>(?<![0-9])[0-9](?:[ -]?[0-9]){{12,18}}(?![0-9]))""",
    regex.VERBOSE,
)
_LOCAL = regex.compile(r"[\p{L}\p{M}\p{N}_.+%-]")
_DOMAIN = regex.compile(r"[\p{L}\p{M}\p{N}-]{1,63}+(?:\.[\p{L}\p{M}\p{N}-]{1,63}+){1,30}+")
#: Signs of an address before its @ at most; more are no address.
_LOCAL_SIGNS = 256
_PERSON = regex.compile(rf"{_PLACE}(?:(?P<m>{_TITLES['m']})|(?P<f>{_TITLES['f']}))\.?[ ](?P<name>(?:\p{{Lu}}\.[ ]?){{0,3}}+{_NAME}(?:[ ](?:\p{{Lu}}\.[ ])?{_NAME}){{0,4}}+)")
_DIGIT = re.compile("[0-9]")
_KINDS = ("iban", "mac", "ip6", "phone", "ssn", "ip", "card")
_GIVEN = {unicodedata.normalize(form, n.capitalize()): sex for (sex, _), names in _NAMES.items() for n in names for form in ("NFC", "NFD")}
_SOME_GIVEN = "|".join(sorted(_GIVEN, key=len, reverse=True))
_UNTITLED = regex.compile(rf"{_PLACE}(?P<name>(?P<given>{_SOME_GIVEN})(?:[ -](?:{_SOME_GIVEN}))?(?:[ ]\p{{Lu}}\.)?[ ]{_NAME})")
#: A text without any of these, in lower case, has no match of `_FIND_SECRETS`.
_SAYS_SECRET = tuple("token secret passw pwd key akia ghp_ gho_ ghu_ ghs_ ghr_ sk- xox aiza bearer eyj".split())
_TOKENS = regex.compile(r"[\p{L}\p{M}\p{N}_]++|[^\p{L}\p{M}\p{N}_]")
#: Signs of a secret that are permuted as one number; longer ones in pieces.
_PIECE = 48
#: Longer entities are not kept by the cache of surrogates.
_KEPT_SIGNS = 256


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        x = int(c) * (1 + n % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


@cache
def _scripts() -> tuple[dict[str, tuple[tuple, int]], dict[tuple, list[str]]]:
    """Classes of all letters and digits outside `_CLASSES`: of a script (the
    first word of the character's name), category, stretch of 2,048 code points,
    and whether it has a capital that reads back. Capitals that have a small
    letter are written by it; letters alone in their class share one."""
    of, members = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if c in _OF_CLASS or kind[0] not in "LN" or (len(c.lower()) == 1 and c.lower() != c):
            continue
        cased = len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c
        members.setdefault((unicodedata.name(c, "").partition(" ")[0], kind, cased, code >> 11), []).append(c)
    for key in [k for k, some in members.items() if len(some) == 1]:
        members.setdefault(key[1:3], []).extend(members.pop(key))
    for key, some in members.items():
        of.update((c, (key, n)) for n, c in enumerate(some))
    return of, members


def _class_of(c: str) -> tuple[object, int] | None:
    """(class, place in it) of a small letter or digit; None for other signs."""
    if c in _OF_CLASS or c.isascii():
        return _OF_CLASS.get(c)
    return _scripts()[0].get(c)


def _members(kind) -> str | list[str]:
    return _CLASSES[kind] if isinstance(kind, int) else _scripts()[1][kind]


class Surrogates:
    """Surrogates of entities under a key of up to 64 bytes."""

    def __init__(self, key: bytes):
        self.key = key
        self._kept = lru_cache(20_000)(self._of)

    def of(self, kind: str, text: str, gender: str = "") -> str:
        return (self._kept if len(text) <= _KEPT_SIGNS else self._of)(kind, text, gender)

    def _round(self, tweak: bytes, n: int, x: int) -> int:
        data = tweak + bytes([n]) + x.to_bytes((x.bit_length() + 7) // 8 or 1, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=64).digest(), "big")

    def _permuted(self, x: int, size: int, tweak: bytes, back: bool) -> int:
        """A keyed permutation of 0..size-1 (a Feistel network on a square,
        walked until it is back in range), or its inverse."""
        side = isqrt(size - 1) + 1
        while True:
            left, right = divmod(x, side)
            for n in reversed(range(8)) if back else range(8):
                if back:
                    left, right = (right - self._round(tweak, n, left)) % side, left
                else:
                    left, right = right, (left + self._round(tweak, n, right)) % side
            x = left * side + right
            if x < size:
                return x

    def next(self, digits: list[int], bases: list[int], tweak: str) -> list[int]:
        """The digits' successor on the format's one keyed cycle."""
        size = prod(bases)
        if size < 2:
            return digits
        mark, x = tweak.encode(), 0
        for digit, base in zip(digits, bases):
            x = x * base + digit
        x = self._permuted((self._permuted(x, size, mark, False) + 1) % size, size, mark, True)
        out = []
        for base in reversed(bases):
            x, digit = divmod(x, base)
            out.append(digit)
        return out[::-1]

    def spelled(self, text: str, kind: str, valid: Callable[[str], bool] = lambda _: True) -> str:
        """Characters by class, case by place. The same text in another case is
        the same entity."""
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        classes = [_class_of(c) for c in low]
        at = [i for i, c in enumerate(classes) if c]
        sets = [_members(classes[i][0]) for i in at]
        bases, digits = [len(x) for x in sets], [classes[i][1] for i in at]
        form = kind + "\0" + "".join(f"\1{classes[i][0]}" if classes[i] else c for i, c in enumerate(low))
        while True:
            digits, out = self.next(digits, bases, form), list(low)
            for i, digit, some in zip(at, digits, sets):
                out[i] = some[digit]
            if not at or valid("".join(out)):
                return "".join(c.upper() if o != n and len(c.upper()) == 1 else c for c, o, n in zip(out, text, low))

    def _of(self, kind: str, text: str, gender: str = "") -> str:
        return getattr(self, kind)(text, gender) if kind == "person" else getattr(self, kind)(text)

    def email(self, text: str) -> str:
        local, _, domain = text.partition("@")
        host, _, top = domain.rpartition(".")
        return self.spelled(f"{local}@{host}", "email") + "." + top

    def secret(self, text: str) -> str:
        """Long ones piece by piece, each on the cycle of its place."""
        hexadecimal = set(text.lower()) <= set(_HEX) and (text.islower() or text.isupper() or text.isdigit())
        sets = (_HEX, _HEX.upper()) if hexadecimal else ("0123456789", string.ascii_lowercase, string.ascii_uppercase)
        sets = sets[text.isupper() :][:1] if hexadecimal else sets
        out = []
        for low in range(0, len(text), _PIECE):
            part = text[low : low + _PIECE]
            of = [next((s for s in sets if c in s), c) for c in part]
            form = f"hex{len(part)}" if hexadecimal else "secret" + "".join(s[0] for s in of)
            digits = self.next([s.index(c) for s, c in zip(of, part)], [len(s) for s in of], f"{form}/{low}" if low else form)
            out += [s[d] for s, d in zip(of, digits)]
        return "".join(out)

    password = api_key = secret

    def mac(self, text: str) -> str:
        """The first half names the maker and stays."""
        at = [i for i, c in enumerate(text) if c not in ":-"][6:]
        digits = self.next([_HEX.index(text[i].lower()) for i in at], [16] * 6, "mac" + regex.sub("[:-]", "", text[:8]).lower())
        out = list(text)
        for i, d in zip(at, digits):
            out[i] = _HEX[d].upper() if text.isupper() or text[i].isupper() else _HEX[d]
        return "".join(out)

    def ip6(self, text: str) -> str:
        """The first group tells the kind of network and stays, and so do groups
        of zero."""
        groups = ipaddress.IPv6Address(text).exploded.split(":")
        at = [i for i in range(1, 8) if int(groups[i], 16)]
        digits = self.next([int(groups[i], 16) - 1 for i in at], [65535] * len(at), "ip6" + groups[0] + "".join(map(str, at)))
        new = iter([f"{d + 1:04x}" for d in digits])
        written = [g for g in text.split(":") if g]
        shift = 8 - len(written)
        # Zeros that are left out are in one place, so written groups are those before it and after it.
        before = len([g for g in text.partition("::")[0].split(":") if g]) if "::" in text else 8
        fresh = {i: next(new) for i in at}
        out = []
        for n, g in enumerate(written):
            place = n if n < before else n + shift
            v = fresh.get(place)
            v = g if v is None else v if len(g) == 4 else v.lstrip("0")
            out.append(v.upper() if text.isupper() else v)
        rest = iter(out)
        return regex.sub("[0-9A-Fa-f]+", lambda _: next(rest), text)

    def phone(self, text: str) -> str:
        """The country code stays; the digits after it are one number however it
        is written. Ten digits without a code, or after a 1, are of country 1."""
        digits = regex.sub("[^0-9]", "", text)
        code = next((digits[:n] for n in (1, 2) if digits[:n] in _COUNTRIES), digits[:3]) if "+" in text else digits[:1] if len(digits) == 11 else ""
        new = self.spelled(digits[len(code) :], "phone" + (code or "1"))
        rest = iter(code + new)
        return "".join(next(rest) if c.isascii() and c.isdigit() else c for c in text)

    def ssn(self, text: str) -> str:
        return self.spelled(text, "ssn")

    def ip(self, text: str) -> str:
        """An address of a private or reserved network gets another of it."""
        number = int(ipaddress.IPv4Address(".".join(str(int(p)) for p in text.split("."))))
        own = next((n for n in _NETWORKS if ipaddress.IPv4Address(number) in n), None)
        if own:
            size, base = own.num_addresses, int(own.network_address)
            return str(ipaddress.IPv4Address(base + self.next([number - base], [size], f"ip{own}")[0]))
        while True:
            number = self.next([number], [1 << 32], "ip")[0]
            if not any(ipaddress.IPv4Address(number) in n for n in _NETWORKS):
                return str(ipaddress.IPv4Address(number))

    def card(self, text: str) -> str:
        """The last digit follows from the others, where it does so at all."""
        digits = regex.sub("[^0-9]", "", text)
        if luhn(digits):
            head = self.spelled(digits[:-1], "card")
            out = next(head + c for c in "0123456789" if luhn(head + c))
        else:
            out = self.spelled(digits, "number", lambda x: not luhn(x))
        rest = iter(out)
        return "".join(next(rest) if c.isdigit() else c for c in text)

    def iban(self, text: str) -> str:
        plain = text.replace(" ", "")
        body = self.spelled(plain[4:], "iban" + plain[:2])
        number = lambda check: int("".join(str(int(c, 36)) for c in body + plain[:2] + check)) % 97
        out = plain[:2] + f"{98 - number('00'):02d}" + body
        rest = iter(out)
        return "".join(c if c == " " else next(rest) for c in text)

    def person(self, text: str, gender: str) -> str:
        """A given name of the lists changes within its list, particles stay.
        Other parts are spelled anew and never become a name of the lists."""
        known = {n for names in _NAMES.values() for n in names}

        def part(word: str) -> str:
            low = word.lower()
            if word in _SMALL:
                return word
            for (sex, script), names in _NAMES.items():
                if low in names and (not gender or sex == gender or low not in {n for (s, c), some in _NAMES.items() if s == gender for n in some}):
                    out = names[self.next([names.index(low)], [len(names)], f"name {sex} {script}")[0]]
                    return out.upper() if word.isupper() and len(word) > 1 else out.capitalize()
            return self.spelled(word, "name", lambda x: x not in known)

        return "".join(p if p in " -'’" else part(p) for p in regex.split(r"([ '’-])", text))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Where e-mail addresses are: from every @ back and on."""
    at = text.find("@")
    while at >= 0:
        low = at
        while low and at - low <= _LOCAL_SIGNS and _LOCAL.match(text, low - 1):
            low -= 1
        if 0 < at - low <= _LOCAL_SIGNS and (domain := _DOMAIN.match(text, at + 1)):
            yield low, domain.end()
        at = text.find("@", at + 1)


def _mentions(text: str, people: dict[str, str]) -> Iterator[tuple[int, int, str]]:
    """(start, end, name) of the longest of the names at each token of the text."""
    tree: dict = {}
    for name in people:
        node = tree
        for token in _TOKENS.findall(name):
            node = node.setdefault(token, {})
        node[""] = name
    tokens = [(m.start(), m.group()) for m in _TOKENS.finditer(text)]
    at = 0
    while at < len(tokens):
        node, n, best = tree, at, None
        while n < len(tokens) and (node := node.get(tokens[n][1])) is not None:
            n += 1
            if "" in node:
                best = (n, node[""])
        if best:
            yield tokens[at][0], tokens[at][0] + len(best[1]), best[1]
        at = best[0] if best else at + 1


def _is_ip6(text: str) -> bool:
    """Written with eight hexadecimal digits at least: shorter ones are as likely times or code."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return sum(c != ":" for c in text) >= 8 and any(int(g, 16) for g in ipaddress.IPv6Address(text).exploded.split(":")[1:])


_CHECKS = {"iban": lambda x: _is_iban(x), "ip6": _is_ip6, "card": lambda x: luhn(regex.sub("[^0-9]", "", x))}


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of what is found, in order and apart."""
    out = [(low, high, "email", "") for low, high in _addresses(text)]
    small = text.lower()
    if any(part in small for part in _SAYS_SECRET):
        out += [(*m.span(kind), kind, "") for m in _FIND_SECRETS.finditer(text) for kind in ("secret", "password", "api_key") if m[kind] is not None]
    if _DIGIT.search(text):
        for m in _FIND_NUMBERS.finditer(text):
            kind = next(k for k in _KINDS if m[k] is not None)
            if kind not in _CHECKS or _CHECKS[kind](m[kind]):
                out.append((*m.span(kind), kind, ""))
    people = {}
    for m in _PERSON.finditer(text):
        people[m["name"]] = "m" if m["m"] else "f"
        word = m["name"].split(" ")[-1]  # the surname alone means the same person, and in capitals too
        for name in (word, word.upper()):
            people.setdefault(name, people[m["name"]])
    for m in _UNTITLED.finditer(text):
        people.setdefault(m["name"], _GIVEN[m["given"]])
        people.setdefault(m["name"].split(" ")[-1], people[m["name"]])
    if people:
        out += [(low, high, "person", people[name]) for low, high, name in _mentions(text, people)]
    kept, end = [], 0
    for x in sorted(out, key=lambda x: (x[0], -x[1], x[2])):
        if x[0] >= end:
            kept.append(x)
            end = x[1]
    return kept


def _is_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _same(text: str, kind: str) -> str:
    """What makes two mentions the same entity."""
    if kind == "ip6":
        return ipaddress.IPv6Address(text).exploded
    if kind == "mac":
        return regex.sub("[:-]", "", text).lower()
    if kind == "ip":
        return ".".join(str(int(p)) for p in text.split("."))
    if kind in ("phone", "card", "iban"):
        plain = regex.sub("[^0-9A-Z]", "", text)
        return plain[1:] if kind == "phone" and len(plain) == 11 and plain[0] == "1" else plain
    return unicodedata.normalize("NFC", text).lower()


def replaced(text: str | None, surrogates: Surrogates) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and where they are in it."""
    found = entities(text) if text else []
    if not found:
        return text, []
    out, spans, at, size, used = [], [], 0, 0, {}
    for start, end, kind, gender in found:
        was = text[start:end]
        new = surrogates.of(kind, unicodedata.normalize("NFC", was), gender)
        while used.setdefault((kind, _same(new, kind)), _same(was, kind)) != _same(was, kind):
            new = surrogates.of(kind, new, gender)
        out += [text[at:start], new]
        size += start - at
        spans.append({"kind": kind, "start": size, "length": len(new)})
        size += len(new)
        at = end
    return "".join([*out, text[at:]]), spans


_SPANS = "array<struct<kind:string,start:int,length:int>>"


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """`docs` with its text column replaced and `spans_col` added: kind, start
    and length (code points) of every surrogate in the new text.

    All other columns stay. Null texts stay null and empty ones empty, both with
    no spans. Repeated rows stay repeated, with equal surrogates. A column of the
    name `spans_col` gives way to the new one.
    """
    docs = docs.drop(spans_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            texts, spans = [], []
            for text in batch.column(place).to_pylist():
                new, found = replaced(text, surrogates)
                texts.append(new)
                spans.append(found)
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], names=[*batch.schema.names, spans_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(trimmed(run), f"{fields}, `{spans_col}` {_SPANS}")


def collisions(originals: DataFrame, key: bytes) -> DataFrame:
    """(kind, surrogate, n): surrogates that several distinct entities share.
    `originals` has kind, value and gender. Empty for any table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            rows = [(k, surrogates.of(k, v, g or ""), v) for k, v, g in zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "gender")))]
            yield pa.RecordBatch.from_pylist([{"kind": k, "surrogate": _same(s, k), "value": _same(v, k)} for k, s, v in rows], schema=pa.schema([("kind", pa.string()), ("surrogate", pa.string()), ("value", pa.string())]))

    mapped = originals.select("kind", "value", "gender").distinct().mapInArrow(run, "kind string, surrogate string, value string")
    shared = mapped.distinct().groupBy("kind", "surrogate").agg(F.count("*").alias("n"))
    return shared.filter("n > 1")
