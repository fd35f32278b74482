"""PII surrogates: keyed, type-consistent replacements for detected entities.

Kinds: e-mail and IP addresses (versions 4 and 6), phone numbers, card numbers, bank
accounts (IBAN), social security numbers, secrets (values of token-like assignments,
keys with a known prefix and long hexadecimal strings) and names (a title, or a known given name, before
capitalised words).

A surrogate keeps the entity's format: every character is replaced by one of its
own class (digit; vowel or consonant of its script; ideograph), marks and case
stay, check digits are made anew, given names come from the pool of their gender
and script. The replacement is a keyed permutation of all strings of that format,
a Feistel network with cycle walking, turned into one without fixed points by
conjugating a shift. So, without any exchange between tasks, the same entity gets the
same surrogate everywhere (coreference) and different ones of a kind and format never
share one. Given names come from a pool that has none of the names the detector knows.

What a permutation cannot know is settled for the whole table: a surrogate must not be
another entity of the table, of any kind, nor the surrogate of one of another kind or
format. The distinct entities are written as a table; where an offer is an entity, or
was offered before, or meets a better one (smaller kind and entity), the entity offers
anew in the next round, under the next derived key. After ``DRAWS`` offers its format is
full and it takes one more character a ``DRAWS`` offers (surnames, secrets, phone numbers,
local parts of addresses), from its second offer on two given names with a hyphen. Kinds
of fixed length (IP, card, IBAN, social security numbers) have room for billions; after
``MOST_DRAWS`` offers the operator raises an error. The entities that are not at their first offer are few
(``fixes``); they are broadcast up to ``BROADCAST_FIXES`` rows and joined to the texts
that hold them beyond. An entity without a letter or digit to replace stays.

The permutation can be undone by who has the key, so a caller has to give one; the
queries take it from the session's setting ``KEY_SETTING``.

Entities are compared without case. Defined cases: null and empty texts stay and
have no entities; repeated rows get equal results; other columns are untouched.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm.common import fresh_name, slices, staged

#: The session's setting that holds the key, and the key of tests and examples: published, so it protects nothing.
KEY_SETTING = "spark.loreweave.surrogates.key"
EXAMPLE_KEY = b"loreweave surrogates"
#: Offers of an entity in its own format before it grows by a character, and offers in all before an error.
DRAWS, MOST_DRAWS = 8, 256
#: Entities beyond their first offer that are broadcast; more are joined.
BROADCAST_FIXES = 20_000

# Given names by gender and script, all alternatives of one pool.
FEMALE = "Alice Amelia Barbara Caroline Charlotte Deborah Dorothy Eleanor Elizabeth Emily Florence Frances Hannah Isabella Jennifer Jessica Katherine Laura Margaret Martha Michelle Nancy Olivia Patricia Rachel Rebecca Rosemary Samantha Sophia Stephanie Susan Victoria".split()
MALE = "Alexander Andrew Anthony Benjamin Charles Christopher Daniel Edward Frederick George Gregory Harold Henry James Jonathan Joseph Kenneth Lawrence Leonard Matthew Michael Nicholas Oliver Patrick Raymond Richard Robert Samuel Stephen Thomas Timothy William".split()
FEMALE_CYRILLIC = "Александра Анастасия Екатерина Елена Ирина Ксения Людмила Мария Наталья Ольга Светлана Татьяна".split()
MALE_CYRILLIC = "Александр Алексей Владимир Григорий Дмитрий Евгений Иван Михаил Николай Павел Сергей Фёдор".split()
# The names that stand for them, none of which is among them.
FOR_FEMALE = "Abigail Adele Agnes Beatrice Brenda Camilla Cecilia Clara Daphne Edith Felicity Georgia Harriet Helen Imogen Josephine Judith Lavinia Lucinda Marjorie Miriam Nadine Penelope Phoebe Regina Rosalind Sylvia Tabitha Ursula Vanessa Wilhelmina Yvonne".split()
FOR_MALE = "Adrian Albert Ambrose Archibald Barnaby Bernard Clement Cornelius Desmond Edgar Ernest Felix Gilbert Harvey Horace Hugh Ignatius Julian Lionel Magnus Maurice Neville Norman Percival Quentin Reginald Roland Rupert Sebastian Sidney Vincent Walter".split()
FOR_FEMALE_CYRILLIC = "Алла Валентина Вера Галина Евгения Зинаида Лариса Маргарита Надежда Полина Раиса Тамара".split()
FOR_MALE_CYRILLIC = "Анатолий Борис Валерий Виктор Геннадий Денис Игорь Константин Леонид Олег Роман Юрий".split()
POOLS = {"female": FEMALE, "male": MALE, "female-cyrillic": FEMALE_CYRILLIC, "male-cyrillic": MALE_CYRILLIC}
FOR_POOLS = {"female": FOR_FEMALE, "male": FOR_MALE, "female-cyrillic": FOR_FEMALE_CYRILLIC, "male-cyrillic": FOR_MALE_CYRILLIC}
# Titles.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame", "Mme"]

# Characters that may stand for each other.
CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöùúûü", "çñýÿšžčř", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
OF_CHAR = {c: k for k in CLASSES for c in k}
HEX = "0123456789abcdef"
IDEOGRAPHS = (0x4E00, 0x9FA5)


@functools.lru_cache(maxsize=4096)
def letters_like(c: str) -> str | None:
    """For letters and digits of other scripts: those of the same kind in the same 128 code points."""
    kind = unicodedata.category(c)
    if kind not in ("Ll", "Lo", "Nd"):
        return None
    first = ord(c) & ~127
    return "".join(x for x in map(chr, range(first, first + 128)) if unicodedata.category(x) == kind)


def class_of(c: str):
    """The characters that may replace a lower-case character, None if it stays."""
    if IDEOGRAPHS[0] <= ord(c) < IDEOGRAPHS[1]:
        return range(*IDEOGRAPHS)
    return OF_CHAR.get(c) or letters_like(c)


class Permutation:
    """A keyed permutation of range(n) for any n, with its inverse."""

    def __init__(self, n: int, key: bytes, tweak: bytes):
        self.n, self.half = n, max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask, self.key, self.tweak = (1 << self.half) - 1, hashlib.blake2b(key).digest(), tweak
        self.shift = 1 + self._round(99, n) % (n - 1) if n > 1 else 0

    def _round(self, i: int, x: int) -> int:
        data = bytes([i]) + x.to_bytes((x.bit_length() + 7) // 8, "big") + b"|" + self.tweak
        size = min(64, self.half // 8 + 9)
        out = hashlib.blake2b(data, key=self.key, digest_size=size).digest()
        while len(out) * 8 < self.half:
            out += hashlib.blake2b(out, key=self.key).digest()
        return int.from_bytes(out, "big")

    def forward(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in range(8):
                a, b = b, a ^ self._round(i, b) & self.mask
            x = a << self.half | b
            if x < self.n:
                return x

    def backward(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in reversed(range(8)):
                a, b = b ^ self._round(i, a) & self.mask, a
            x = a << self.half | b
            if x < self.n:
                return x

    def moved(self, x: int) -> int:
        """A permutation's image of x that is never x itself (if n > 1)."""
        return self.backward((self.forward(x) + self.shift) % self.n)


def luhn(digits: str) -> int:
    """The check digit that the digits before it call for."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, bban: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in (bban + country + '00').lower())) % 97:02d}"


def folded(text: str) -> str:
    """Lower case, character by character."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def canonical(kind: str, text: str) -> str:
    """What all spellings of an entity share."""
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))  # 01.2.3.4 is 1.2.3.4
    if kind in ("card", "iban"):
        return re.sub(r"[\s-]", "", text).lower()
    return folded(text)


class Surrogates:
    """Surrogates under one key."""

    def __init__(self, key: bytes):
        self.key = key
        self.of = functools.lru_cache(maxsize=100_000)(self._of)

    def spelled(self, kind: str, text: str, alphabets=None) -> str:
        """Each character replaced within its class; the rest stays and is part of the format."""
        low = folded(text)
        sets = [alphabets(c) if alphabets else class_of(c) for c in low]
        x = 0
        n = 1
        for c, s in zip(low, sets, strict=True):
            if s is not None:
                x = x * len(s) + (ord(c) - s[0] if isinstance(s, range) else s.index(c))
                n *= len(s)
        if n == 1:
            return text
        form = "\0".join(c if s is None else f"\1{s[0]}" for c, s in zip(low, sets, strict=True))
        x = Permutation(n, self.key, f"{kind}:{form}".encode()).moved(x)
        out = []
        for c, s, old in zip(reversed(low), reversed(sets), reversed(text), strict=True):
            if s is not None:
                x, i = divmod(x, len(s))
                c = chr(s[i]) if isinstance(s, range) else s[i]
            out.append(c.upper() if old.isupper() and c.upper().lower() == c else c)
        return "".join(reversed(out))

    def pooled(self, pool: str, name: str) -> str:
        found = FOR_POOLS[pool][Permutation(len(FOR_POOLS[pool]), self.key, pool.encode()).moved([n.lower() for n in POOLS[pool]].index(name.lower()))]
        return found.upper() if name.isupper() and len(name) > 1 else found

    def doubled(self, pool: str, name: str) -> str:
        """Two different names of the pool, for a name whose own is taken."""
        stands, known = FOR_POOLS[pool], [n.lower() for n in POOLS[pool]]
        rest = len(stands) - 1
        a, b = divmod(Permutation(len(stands) * rest, self.key, f"two:{pool}".encode()).forward(known.index(name.lower())), rest)
        found = f"{stands[a]}-{stands[b + (b >= a)]}"
        return found.upper() if name.isupper() and len(name) > 1 else found

    def _of(self, kind: str, text: str) -> str:
        return getattr(self, f"_{kind}")(text)

    def _email(self, text: str) -> str:
        local, _, domain = text.rpartition("@")
        first, *rest = domain.split(".")
        if not rest[1:]:
            return self.spelled("email", f"{local}@{first}") + "." + ".".join(rest)
        return self.spelled("email:" + ".".join(rest).lower(), f"{local}@{first}") + "." + ".".join(rest)

    def _ip(self, text: str) -> str:
        n = int.from_bytes(bytes(map(int, text.split("."))), "big")
        return ".".join(map(str, Permutation(1 << 32, self.key, b"ip").moved(n).to_bytes(4, "big")))

    def _ip6(self, text: str) -> str:
        return self.spelled("ip6", text, lambda c: HEX if c in HEX else None)

    def _phone(self, text: str) -> str:
        code = re.match(r"\+\d{1,3}(?=\D)|\+\d", text)
        head = code[0] if code else ""
        return head + self.spelled("phone:" + head, text[len(head) :], lambda c: CLASSES[0] if c in CLASSES[0] else None)

    def _card(self, text: str) -> str:
        digits = re.sub(r"\D", "", text)
        off = (int(digits[-1]) - luhn(digits[:-1])) % 10  # kept, so valid stays valid and invalid invalid
        body = self.spelled("card", digits[:-1])
        new = iter(body + str((luhn(body) + off) % 10))
        return "".join(next(new) if c.isdigit() else c for c in text)

    def _ssn(self, text: str) -> str:
        return self.spelled("ssn", text)

    def _iban(self, text: str) -> str:
        solid = re.sub(r"\s", "", text)
        alnum = lambda c: CLASSES[0] if c in CLASSES[0] else "abcdefghijklmnopqrstuvwxyz" if c.isascii() and c.isalpha() else None
        bban = self.spelled("iban:" + solid[:2].lower(), solid[4:], alnum)
        new = iter(solid[:2] + iban_check(solid[:2], bban) + bban)
        return "".join(c if c.isspace() else next(new) for c in text)

    def _secret(self, text: str) -> str:
        if re.fullmatch(r"[0-9a-fA-F]+", text):
            return self.spelled("hex", text, lambda c: HEX if c in HEX else None)
        return self.spelled("secret", text, lambda c: CLASSES[0] if c in CLASSES[0] else "abcdefghijklmnopqrstuvwxyz" if c.isascii() and c.isalpha() else class_of(c))

    def _surname(self, text: str) -> str:
        return self.spelled("surname", text)

    def _given(self, text: str) -> str:
        return self.pooled(GIVEN[text.lower()], text)


GIVEN = {n.lower(): pool for pool, names in POOLS.items() for n in names}
_GAP = r"[^\w\n+(]{0,6}"
_WORD = r"[^\W\d_][^\W\d_'’-]*"
# Fixed value: the alternatives of the detector, in the order in which they are tried at a place.
DETECT = {
    "email": r"(?P<email>(?<![\w.+\-])[\w.+\-]*\w[+\-]*@[\w\-]+(?:\.[\w\-]+)+)",
    "ip": r"(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w])(?!\.\d))",
    "phone": rf"(?P<phone>\+\d{{1,3}}{_GAP}\(?\d{{2,4}}\)?{_GAP}\d{{2,4}}(?:{_GAP}\d{{2,4}}){{1,3}}(?!\w)|(?<!\w)\(\d{{3}}\) ?\d{{3}}-\d{{4}}(?!\w)|(?<![\w.-])\d{{3}}[-.]\d{{3}}[-.]\d{{4}}(?![\w-]))",
    "ssn": r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
    "iban": r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))",
    "card": r"(?P<card>(?<![\w.])\d{13,19}(?!\w)|(?<![\w.-])\d{4}(?:[ -]\d{4}){3}(?![\w-]))",
    "key": r"(?P<key>(?i:(?<![^\W_])(?:token|secret|passwo?r?d|api[_-]?key|access[_-]?key)\W{1,12}))(?P<value>[A-Za-z0-9+/_\-]{8,})",
    "prefix": r"(?<!\w)(?:(?:AKIA|ASIA)(?P<cloud>[A-Z0-9]{16})|gh[pousr]_(?P<forge>[A-Za-z0-9]{36,}))(?!\w)",
    "ip6": r"(?P<ip6>(?<![\w:.])[0-9a-fA-F]{1,4}(?:::?[0-9a-fA-F]{1,4}){2,7}(?![\w:]))",
    "hex": r"(?P<hex>(?<!\w)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w))",
}
NAMES = re.compile(rf"(?<!\w)(?:(?P<title>{'|'.join(TITLES)})\b\.? (?P<titled>(?=[^\W\d_]){_WORD}(?: {_WORD})?)|(?P<first>{'|'.join(n for p in POOLS.values() for n in p)}) (?P<last>{_WORD}))")
#: What every match of these alternatives holds; all of them hold a digit.
SHAPES = {"ip": r"\d\.\d", "phone": r"\+\d|\d{3}[-.]\d", "ssn": r"\d-\d\d-\d", "iban": r"[A-Z]{2}\d\d", "card": r"\d{4}[ -]?\d{4}"}
SHAPES = {name: re.compile(shape).search for name, shape in SHAPES.items()}
DIGIT, MIDDLE_GROUP, FORGE = re.compile(r"\d").search, re.compile(r":[0-9a-fA-F]{1,4}:").search, re.compile(r"gh[pousr]_").search
NOT_DIGITS = bytes(b for b in range(256) if b not in b"0123456789")
#: Hexadecimal digits of both cases become one byte, the rest another, so that a run of them is found as a string.
HEX_RUNS, HEX_RUN = bytes(b"- "[b not in b"0123456789abcdefABCDEF"] for b in range(256)), b"-" * 32
NAME_WORDS = frozenset([*TITLES, *(n for p in POOLS.values() for n in p)])
#: Runs of word characters, from the first on that a name may begin with.
NAME_RUNS = re.compile(f"[{''.join(sorted({n[0] for n in NAME_WORDS}))}]\\w*").findall


def alternatives(text: str) -> tuple[str, ...]:
    """The alternatives of DETECT that may match somewhere in a text; the others cannot."""
    raw = text.encode("utf-8", "replace")
    low = text.lower() if text.isascii() else text.lower().replace("ſ", "s")  # what (?i:s) takes
    found = {
        "email": "@" in text,
        "key": "key" in low or "token" in low or "secret" in low or "passw" in low,
        "prefix": "AKIA" in text or "ASIA" in text or "_" in text and FORGE(text),
        "ip6": ":" in text and MIDDLE_GROUP(text),
        "hex": HEX_RUN in raw.translate(HEX_RUNS),
    }
    if raw.translate(None, NOT_DIGITS) or not text.isascii() and DIGIT(text):
        found |= {name: shape(text) for name, shape in SHAPES.items()}
    return tuple(name for name in DETECT if found.get(name))


@functools.cache
def detector(names: tuple[str, ...]) -> re.Pattern:
    """The detector of some alternatives; it finds what that of all finds where the others cannot match."""
    return re.compile("|".join(DETECT[name] for name in names))


def _is_kind(kind: str, text: str) -> bool:
    """Whether a match of the detector is what its kind asks for."""
    if kind == "ip":
        return all(int(x) < 256 for x in text.split("."))
    if kind == "ip6":
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return False
    if kind == "iban":
        solid = re.sub(r"\s", "", text)
        return len(solid) >= 15 and iban_check(solid[:2], solid[4:]) == solid[2:4]
    return True


def entities(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the entities of a text, in order, not overlapping."""
    found = []
    names = alternatives(text)
    if names:
        for m in detector(names).finditer(text):
            kind = m.lastgroup
            span = m.span(kind)
            kind = "secret" if kind in ("value", "hex", "cloud", "forge") else kind
            if _is_kind(kind, text[slice(*span)]):
                found.append((*span, kind))
    if not NAME_WORDS.isdisjoint(NAME_RUNS(text)):
        taken = [(a, b) for a, b, _ in found]
        for m in NAMES.finditer(text):
            words = []
            for group in ("titled", "first", "last"):
                if m[group]:
                    at = m.start(group)
                    for w in m[group].split(" "):
                        words.append((at, at + len(w), w))
                        at += len(w) + 1
            words = [w for w in words if w[2][0].isupper()]
            if m["first"] and len(words) < 2:
                continue
            for a, b, w in words:
                if not any(a < y and x < b for x, y in taken):
                    found.append((a, b, "given" if w.lower() in GIVEN else "surname"))
    return sorted(found)


@functools.cache
def surrogates(key: bytes, draw: int = 0) -> Surrogates:
    """The surrogates of a key, or of one of those derived from it."""
    return Surrogates(key if not draw else hashlib.blake2b(b"%d" % draw, key=hashlib.blake2b(key).digest()).digest())


#: Kinds whose surrogates may grow.
GROWS = {"surname", "secret", "phone", "email"}


def drawn(kind: str, text: str, key: bytes, draw: int = 0) -> str:
    """An entity's surrogate at its offer number ``draw``."""
    if kind == "given":
        return surrogates(key, draw).doubled(GIVEN[text.lower()], text) if draw else surrogates(key).of(kind, text)
    more = draw // DRAWS
    if more and kind == "email":
        local, _, domain = text.rpartition("@")
        text = f"{local}{'a' * more}@{domain}"
    elif more and kind in GROWS:
        last = [c for c in text if class_of(folded(c)) is not None][-1:] or [""]
        text += last[0] * more
    return surrogates(key, draw).of(kind, text)


def offer(kind: str, entity: str, key: bytes, draw: int) -> str:
    """The canonical form of a canonical entity's surrogate."""
    return canonical(kind, drawn(kind, entity, key, draw))


def mentioned(text: str | None) -> set[tuple[str, str]]:
    """``(kind, canonical entity)`` of a text, distinct."""
    return {(kind, canonical(kind, text[a:b])) for a, b, kind in entities(text)} if text else set()


def _no_room(draw: int, example) -> None:
    if draw >= MOST_DRAWS:
        raise ValueError(f"no room for surrogates of kind {example[0]} after {draw} offers")


def draws_of(known: set[tuple[str, str]], key: bytes) -> dict[str, int]:
    """``kind:entity`` to draw, where it is not 0, for one text's entities: the rounds of ``fixes`` in plain loops."""
    taken, out, draw = {e for _, e in known}, {}, 0
    open_ = sorted(k for k in known if offer(*k, key, 0) != k[1])
    while open_:
        _no_room(draw, open_[0])
        lost, offered = [], set()
        for kind, entity in open_:
            word = offer(kind, entity, key, draw)
            if word in taken or word in offered:
                lost.append((kind, entity))
            elif draw:
                out[f"{kind}:{entity}"] = draw
            offered.add(word)
        taken |= offered
        open_, draw = lost, draw + 1
    return out


def replace(text: str, key: bytes, draws: dict[str, int] | None = None) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and the entities by their places in the original.

    ``draws`` has the offers that hold in the corpus; without it the text is a corpus of its own.
    """
    found = entities(text)
    if not found:
        return text, found
    if draws is None:
        draws = draws_of(mentioned(text), key)
    out, at = [], 0
    for a, b, kind in found:
        old = text[a:b]
        out += [text[at:a], drawn(kind, old, key, draws.get(f"{kind}:{canonical(kind, old)}", 0) if draws else 0)]
        at = b
    return "".join(out) + text[at:], found


OFFER = pa.schema([("kind", pa.string()), ("entity", pa.string()), ("word", pa.string())])


def _offers(known: DataFrame, key: bytes, draw: int) -> DataFrame:
    """``kind, entity, word`` of what entities offer at a draw; without those that have nothing to replace."""

    def run(batches):
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield pa.RecordBatch.from_pylist([{"kind": k, "entity": e, "word": offer(k, e, key, draw)} for k, e in pairs], OFFER)

    return known.select("kind", "entity").mapInArrow(run, "kind string, entity string, word string")


def fixes(docs: DataFrame, key: bytes) -> DataFrame:
    """``kind, entity, draw`` of the table's entities whose surrogate is not their first offer, a written table."""

    def run(batches):
        for part in slices(batches):
            known = sorted(set().union(*map(mentioned, part.column(0).to_pylist())))
            yield pa.RecordBatch.from_pylist([{"kind": k, "entity": e} for k, e in known], pa.schema([OFFER.field(0), OFFER.field(1)]))

    known = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, entity string").distinct()
    first = staged(_offers(known, key, 0), "surrogates-offered")
    offers = first.filter("word <> entity")
    words = first.select(F.col("entity").alias("word"), F.lit(True).alias("is_entity"), F.lit(None).cast("struct<kind:string,entity:string>").alias("by"))
    words = words.unionByName(offers.select("word", F.lit(False).alias("is_entity"), F.struct("kind", "entity").alias("by")))
    met = words.groupBy("word").agg(F.max("is_entity").alias("is_entity"), F.min("by").alias("by"), F.count("by").alias("n"))
    met = met.filter("n > 1 or (n > 0 and is_entity)")
    lost = offers.join(met, "word").filter(F.col("is_entity") | (F.struct("kind", "entity") != F.col("by"))).select("kind", "entity")
    lost = staged(lost, "surrogates-lost")
    taken = first.select(F.explode(F.array("entity", "word")).alias("word"))
    settled = lost.limit(0).withColumn("draw", F.lit(0))
    draw = 1
    while (example := lost.head()) is not None:
        _no_room(draw, example)
        now = staged(_offers(lost, key, draw), "surrogates-offered")
        best = now.join(taken, "word", "left_anti").groupBy("word").agg(F.min(F.struct("kind", "entity")).alias("by")).select("by.*")
        best = staged(best, "surrogates-settled")
        settled = settled.unionByName(best.withColumn("draw", F.lit(draw)))
        taken = taken.unionByName(now.select("word"))
        lost = staged(lost.join(best, ["kind", "entity"], "left_anti"), "surrogates-lost")
        draw += 1
    return settled


def _with_draws(docs: DataFrame, key: bytes, name: str, most: int) -> tuple[DataFrame, dict[str, int]]:
    """``docs`` with a map ``name`` of the draws that a row's own entities need, or null and one small map for all rows."""
    found = fixes(docs, key)
    few = found.limit(most + 1).collect()
    if len(few) <= most:
        return docs.withColumn(name, F.lit(None).cast("map<string,int>")), {f"{r.kind}:{r.entity}": r.draw for r in few}

    def run(batches):
        schema = pa.schema([("digest", pa.string()), OFFER.field(0), OFFER.field(1)])
        for part in slices(batches):
            for digest, text in zip(part.column(1).to_pylist(), part.column(0).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([{"digest": digest, "kind": k, "entity": e} for k, e in sorted(mentioned(text))], schema)

    digest = fresh_name(docs, "surrogates_digest")
    texts = docs.select(F.col("text").cast("string").alias("text")).select("text", F.sha2("text", 256).alias("digest")).filter("text is not null")
    held = texts.mapInArrow(run, "digest string, kind string, entity string").distinct().join(found, ["kind", "entity"])
    id_ = F.concat("kind", F.lit(":"), "entity")
    maps = held.groupBy(F.col("digest").alias(digest)).agg(F.map_from_entries(F.collect_list(F.struct(id_, "draw"))).alias(name))
    return docs.withColumn(digest, F.sha2(F.col("text").cast("string"), 256)).join(maps, digest, "left").drop(digest), {}


def surrogate_texts(docs: DataFrame, key: bytes, broadcast_fixes: int = BROADCAST_FIXES) -> DataFrame:
    """``doc_id, text, n_entities, kinds`` of every row; null texts stay null."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    drawn_, all_ = _with_draws(docs, key, "draws", broadcast_fixes)

    def run(batches):
        for part in slices(batches):
            rows = []
            for doc_id, text, own in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                new, found = replace(text, key, dict(own) if own else all_) if text else (text, [])
                rows.append({"doc_id": doc_id, "text": new, "n_entities": len(found), "kinds": ",".join(sorted({k for *_, k in found}))})
            yield pa.RecordBatch.from_pylist(rows, OUT)

    return drawn_.select("doc_id", "text", "draws").mapInArrow(run, "doc_id long, text string, n_entities int, kinds string")


OUT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_entities", pa.int32()), ("kinds", pa.string())])


def with_surrogates(docs: DataFrame, key: bytes, broadcast_fixes: int = BROADCAST_FIXES) -> DataFrame:
    """``docs`` with ``text`` replaced, and ``n_chars`` counted anew where it was the text's length."""
    draws = fresh_name(docs, "surrogate_draws")
    marked, all_ = _with_draws(docs, key, draws, broadcast_fixes)

    @F.pandas_udf("string")
    def replaced(texts, own):
        import pandas as pd

        return pd.Series([replace(t, key, dict(o) if o else all_)[0] if t else t for t, o in zip(texts, own, strict=True)], dtype=object)

    new = replaced(F.col("text").cast("string"), F.col(draws))
    if "n_chars" not in docs.columns:
        return marked.withColumn("text", new).select(docs.columns)
    counted = fresh_name(marked, "n_chars_counted")
    marked = marked.withColumn(counted, F.col("n_chars") == F.char_length("text")).withColumn("text", new)
    length = F.when(F.col(counted), F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return marked.withColumn("n_chars", length).select(docs.columns)


def key_of(spark: SparkSession) -> bytes:
    """The session's key; the published example where none is set."""
    key = spark.conf.get(KEY_SETTING, None)
    return key.encode() if key else EXAMPLE_KEY


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every whole text with surrogates."""
    return surrogate_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), key_of(spark))
