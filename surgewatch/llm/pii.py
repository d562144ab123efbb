"""Personal data: detected entities get keyed surrogates of the same type and format.

Detected: e-mail addresses, phone numbers, card numbers, IBANs, IPv4 and IPv6
addresses, US social security numbers, access keys, web tokens and secrets in
assignments, and names after a title or after words that introduce a name
("my name is"). A surrogate keeps the entity's format: digits stay digits,
letters keep their case and script, punctuation, lengths, country codes and
check digits stay; a name keeps its gender and script, and its parts are
replaced one by one, so a mention by surname alone, with a title or
without, still agrees if the text has the name after a title. A given name that
the text uses with a title of one gender has that gender after "Dr" too.

A surrogate is a keyed permutation of the entity within its format, so two
entities never share one; names come from lists of their gender and script,
with as many parts as are needed. Spark collects the distinct entities and
checks: a surrogate that two entities share, or that is itself an entity of the
corpus, goes to its next attempt until none is left; only those entities are
carried to the next round. A format that is used up (all its values are entities)
does not hold them forever: from attempt ``GIVE_UP`` on a keyed string is added. Only entities that moved
past their first attempt are joined back to the documents.

Cards, phones, IBANs and social security numbers are known by their digits, however
they are punctuated. What has no letter or digit to replace is no entity. The same entity has the same surrogate in all documents (for one ``key``).

Defined cases: null text stays null, empty text empty; a text without entities
is unchanged; a null id is replaced like any other; rows that share an id are
replaced alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgewatch.llm.exchange import arrow_schema, saved

#: Titles by gender (``x`` tells none).
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "г-жа"],
          "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "г-н"], "x": ["Dr", "Prof"]}
#: Given names by gender and script, and surnames by script.
GIVEN = {
    ("f", "latin"): ["Alma", "Berta", "Clara", "Dora", "Edith", "Flora", "Greta", "Hilda", "Irma", "Julia", "Karla", "Lena", "Marta", "Nora", "Olga", "Paula"],
    ("m", "latin"): ["Albert", "Bruno", "Conrad", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jakob", "Karl", "Leo", "Martin", "Noah", "Oscar", "Paul"],
    ("x", "latin"): ["Alex", "Chris", "Dominique", "Jamie", "Kim", "Luca", "Nikola", "Robin", "Sam", "Toni", "Andrea", "Sascha", "Jean", "Noor", "Eli", "Ariel"],
    ("f", "cyrillic"): ["Алла", "Вера", "Дарья", "Елена", "Зоя", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Раиса", "Софья"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Лев", "Марк", "Олег"],
    ("x", "cyrillic"): ["Саша", "Женя", "Валя", "Слава", "Шура", "Паша"],
}
SURNAMES = {
    "latin": ["Abel", "Brandt", "Costa", "Dahl", "Ebner", "Fabre", "Garner", "Holm", "Ibarra", "Jensen", "Keller", "Lorca", "Mercer", "Nolan", "Ortega", "Perrin",
              "Quint", "Rossi", "Sander", "Torres", "Ullman", "Vidal", "Weber", "Xander", "York", "Zeller"],
    "cyrillic": ["Абрамов", "Белов", "Волков", "Громов", "Данилов", "Ершов", "Жуков", "Зимин", "Ильин", "Козлов", "Лаптев", "Миронов"],
}
#: Words that introduce a name, and particles inside one.
INTRODUCTIONS = ["my name is", "my name's", "mein Name ist", "ich heiße", "je m'appelle", "mon nom est", "me llamo", "mi nombre es", "mi chiamo", "меня зовут"]
PARTICLES = ["van der", "van den", "van", "von der", "von", "de la", "de", "del", "della", "di", "da", "dos", "du", "le", "ter", "bin"]
CAP = r"(?:[OD]['’]|Mc|Mac)?[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+)?"
GENDER = {t.lower(): g for g, titles in TITLES.items() for t in titles}

EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9-])")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
NUMBER = re.compile(
    rf"(?P<ip>(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?![\w]|\.[0-9]))"
    r"|(?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?![0-9])(?:[ .-][0-9]{2,4}(?![0-9])){1,3}|\+[0-9]{8,15}(?![0-9])"
    r"|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|[0-9]{3}(?P<dot>[.-])[0-9]{3}(?P=dot)[0-9]{4}(?![0-9-])"
    r"|\(?0[0-9]{2}\)? [0-9]{4} [0-9]{4}(?![\w-])|\(?0[0-9]{3}\)? [0-9]{3} [0-9]{4}(?![\w-])|0[0-9]{4} [0-9]{6}(?![\w-])))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])[3-6][0-9]{12,18}(?![\w-])|(?<![\w-])[3-6][0-9]{3}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}(?![\w-]))")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
HEXES = r"[0-9A-Fa-f]{1,4}"
IP6 = re.compile(rf"(?<![\w:.])(?:(?:{HEXES}:){{7}}{HEXES}|(?:{HEXES}:){{1,6}}(?::{HEXES}){{1,6}})(?![\w:])")
DIGIT, DIGIT_RUN, ASSIGNED = re.compile(r"[0-9]"), re.compile(r"[0-9]*"), re.compile(r"[=:]")
ACCESS_KEYS = [re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Z])"), re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
               re.compile(r"eyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{10,}")]
#: A password of small letters alone, unquoted after a colon, is taken for prose ("password: required") below this length.
PROSE = 16
SECRET_NAME = re.compile(r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}\Z")
TELLING = re.compile(r"(?i:password|passwd|pwd|secret|api[_-]?key|access[_-]?key)\s{0,3}\Z")
SECRET_VALUE = re.compile(r"\s{0,3}(?P<quote>[\"'])?(?P<value>[A-Za-z0-9+/_.-]{8,})")
TITLE = "|".join(re.escape(t) for titles in TITLES.values() for t in titles)
WORD = re.compile(r"\w+")
CAPITAL = re.compile(r"(?<!\w)[A-ZÀ-ÖØ-ÞА-ЯЁ]\w*")
PARTS = "(?:(?:" + "|".join(re.escape(p) for p in PARTICLES) + ") )?"
NAME = re.compile(rf"(?P<title>{TITLE})\.? (?:(?P<first>{CAP}) {PARTS}(?P<last>{CAP})|{PARTS}(?P<only>{CAP}))")
INTRODUCED = re.compile("(?:" + "|".join(f"[{i[0].upper()}{i[0].lower()}]{re.escape(i[1:])}" for i in INTRODUCTIONS) + rf") (?P<first>{CAP})(?: {PARTS}(?P<last>{CAP}))?")
#: A text without any of these introduces no name: it is not searched with the pattern.
INTRODUCING = [i[1:] for i in INTRODUCTIONS]
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Kinds whose entity is its digits, however they are written (a phone number with its ``+``).
NUMBERS = frozenset(["card", "phone", "ssn"])
COUNTRY = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})")
GIVE_UP = 8
ENTITY = "kind string, value string"
MAX_BROADCAST = 200_000


def _untitled(text: str, titled: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Mentions without a title of the titled names of the same text, also in capitals.

    A mention is of the kind that its name had last before it (else first after it).
    """
    known: dict[str, list[tuple[int, str]]] = {}
    for start, _, kind, value in titled:
        for spelling in {value, value.upper()} if value.upper().lower() == value.lower() else {value}:
            known.setdefault(spelling, []).append((start, kind))
    found, past = [], 0
    for m in CAPITAL.finditer(text) if known else ():
        start, end = m.span()
        if start < past:
            continue
        joined = WORD.match(text, end + 1) if text.startswith(("-", "'", "’"), end) else None
        if joined and text[start:joined.end()] in known:
            end = joined.end()
        name = text[start:end]
        if name in known:
            uses = known[name]
            found.append((start, end, uses[max(0, bisect.bisect_left(uses, (start,)) - 1)][1], name))
            past = end
    return found


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, value)`` of the entities, in order and not overlapping."""
    found = []
    at = text.find("@")
    while at >= 0:
        local = LOCAL.search(text, max(0, at - 64), at)
        m = EMAIL.match(text, local.start() + len(local[0]) - len(local[0].lstrip("._%+-"))) if local else None
        if m and m.end() > at:
            found.append((m.start(), m.end(), "email", m[0]))
        at = text.find("@", at + 1)
    # patterns are tried only where a rare character stands (a digit, an assignment, a capital): most text has none
    at = 0
    while m := DIGIT.search(text, at):
        s = m.start()
        account = IBAN.match(text, s - 2) if s - at >= 2 and text[s - 2:s].isupper() else None
        if account and iban_check(account[0].replace(" ", "")) == account[0][2:4]:
            found.append((s - 2, account.end(), "iban", account[0]))
            at = account.end()
            continue
        hit = NUMBER.match(text, s - 1) if s > at and text[s - 1] in "+(" else None
        hit = hit or NUMBER.match(text, s)
        if hit:
            found.append((hit.start(), hit.end(), hit.lastgroup or "phone", hit[0]))
        at = hit.end() if hit else DIGIT_RUN.match(text, s).end()
    if "::" in text or text.count(":") >= 7:
        found += [(m.start(), m.end(), "ip6", m[0]) for m in IP6.finditer(text) if not m[0].replace(":", "").isdigit() or m[0].count(":") == 7]
    for pattern in ACCESS_KEYS:
        found += [(m.start(), m.end(), "secret", m[0]) for m in pattern.finditer(text) if not (m.start() and text[m.start() - 1].isalnum())]
    for m in ASSIGNED.finditer(text):
        value = SECRET_VALUE.match(text, m.end()) if SECRET_NAME.search(text, max(0, m.start() - 14), m.start()) else None
        if value:
            raw, lo = value["value"].rstrip("."), value.start("value")
            # a password may be letters alone; behind a mere "token" unquoted words are mostly code and prose
            telling = TELLING.search(text, max(0, m.start() - 14), m.start())
            prose = m[0] == ":" and not value["quote"] and len(raw) < PROSE and raw.isascii() and raw.isalpha() and raw[1:].islower()
            if any(c.isalnum() for c in raw) and (sum(c.isdigit() for c in raw) >= 2 or len(raw) >= 8 and not prose and (value["quote"] or telling)):
                found.append((lo, lo + len(raw), "secret", raw))
    titled = []
    for m in NAME.finditer(text):
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
            continue
        gender = GENDER[m["title"].lower()]
        if m["last"]:
            titled.append((*m.span("first"), f"given-{gender}", m["first"]))
            titled.append((*m.span("last"), "surname", m["last"]))
        else:
            titled.append((*m.span("only"), "surname", m["only"]))
    for m in INTRODUCED.finditer(text) if any(w in text for w in INTRODUCING) else ():
        titled.append((*m.span("first"), "given-x", m["first"]))
        if m["last"]:
            titled.append((*m.span("last"), "surname", m["last"]))
    # one person, one name: a title without gender takes the gender that the text gives the name elsewhere
    genders: dict[str, set[str]] = {}
    for _, _, kind, value in titled:
        if kind in ("given-f", "given-m"):
            genders.setdefault(value.lower(), set()).add(kind)
    titled = sorted((s, e, next(iter(genders[v.lower()])) if k == "given-x" and len(genders.get(v.lower(), ())) == 1 else k, v) for s, e, k, v in titled)
    found += titled + _untitled(text, titled)
    found.sort(key=lambda f: (f[0], f[0] - f[1]))
    out, end = [], 0
    for f in found:
        if f[0] >= end:
            out.append(f)
            end = f[1]
    return out


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def permuted(value: str, alphabets: list[str | None], key: bytes, tweak: str) -> str:
    """A keyed bijection on the strings of one format: a Feistel network over two halves of the free places."""
    free = [i for i, a in enumerate(alphabets) if a]
    if not free:
        return value
    places = [[i for k, i in enumerate(free) if k % 2 == side] for side in (0, 1)]
    sizes, halves = [], []
    for side in places:
        size = number = 0
        size = 1
        for i in side:
            number = number * len(alphabets[i]) + alphabets[i].index(value[i])
            size *= len(alphabets[i])
        sizes.append(size)
        halves.append(number)
    shape = "".join("." if a else value[i] for i, a in enumerate(alphabets))
    for r in range(8):
        side = r % 2
        halves[side] = (halves[side] + _number(key, tweak, shape, r, halves[1 - side])) % sizes[side]
    out = list(value)
    for side, number in zip(places, halves, strict=True):
        for i in reversed(side):
            number, k = divmod(number, len(alphabets[i]))
            out[i] = alphabets[i][k]
    return "".join(out)


def _classes(value: str, letters: bool = True) -> list[str | None]:
    hexadecimal = re.fullmatch(r"[0-9a-f]{16,}", value)
    small = "abcdef" if hexadecimal else LOWER
    return [DIGITS if c in DIGITS else small if letters and c in small else UPPER if letters and c in UPPER else None for c in value]


def luhn(digits: str) -> int:
    """The check digit that belongs after ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(value: str) -> str:
    """The two check digits that belong to an IBAN without spaces (ISO 7064)."""
    number = "".join(str(int(c, 36)) for c in value[4:] + value[:2])
    return f"{98 - int(number + '00') % 97:02d}"


def script_of(value: str) -> str:
    return "cyrillic" if any("CYRILLIC" in unicodedata.name(c, "") for c in value) else "latin"


def _digits(kind: str, value: str, key: bytes, attempt: int) -> str:
    """The surrogate of a number in its normal form."""
    tweak = f"{kind}:{attempt}"
    if kind != "card":
        code = COUNTRY.match(value)   # from the digits alone, so that all spellings of a number keep the same places
        return permuted(value, [DIGITS if i >= (code.end() if code else 0) else None for i in range(len(value))], key, tweak)
    classes: list[str | None] = [None] + [DIGITS] * (len(value) - 1)
    if luhn(value[:-1]) == int(value[-1]):
        out = permuted(value[:-1] + "0", [*classes[:-1], None], key, tweak + ":checked")[:-1]
        return out + str(luhn(out))
    out = permuted(value, classes, key, tweak)
    if luhn(out[:-1]) == int(out[-1]):
        return _digits(kind, out, key, attempt)   # walk on inside the unchecked numbers: still a bijection
    return out


def _laid(digits: str, mention: str) -> str:
    """The digits of a normal form in the punctuation of a mention."""
    left = iter(digits.lstrip("+"))
    return "".join(next(left) if c in DIGITS else c for c in mention)


def surrogate(kind: str, value: str, key: bytes, attempt: int) -> str:
    """The replacement of an entity at an attempt; a number's keeps the punctuation of ``value``, others are given in normal spelling."""
    tweak = f"{kind}:{attempt}"
    if kind.startswith("given") or kind == "surname":
        script = script_of(value)
        names = SURNAMES[script] if kind == "surname" else GIVEN[kind[-1], script]
        others = [n for n in names if n.lower() != value.lower()]
        parts = [others[_number(key, "name", kind, value.lower(), attempt, k) % len(others)] for k in range(1 + (attempt + 1) // 2)]
        return "-".join(parts)
    if kind == "ip":
        octets = "".join(chr(256 + int(o)) for o in value.split("."))
        alphabet = "".join(chr(256 + k) for k in range(256))
        out = ".".join(str(ord(c) - 256) for c in permuted(octets, [alphabet] * 4, key, tweak))
    elif kind == "email":
        local, domain = value.split("@")
        domain = domain.lower()
        label, top = domain.rsplit(".", 1)
        # one domain, one surrogate domain: permuted labels under a top-level name that is reserved
        out = permuted(local, _classes(local), key, tweak) + "@" + permuted(label, _classes(label), key, "domain") + f".{top}.example"
    elif kind in NUMBERS:
        out = _laid(_digits(kind, normal(kind, value), key, attempt), value)
    elif kind == "iban":
        bare = normal(kind, value)
        out = permuted(bare, [None] * 4 + _classes(bare[4:]), key, tweak)
        left = iter(out[:2] + iban_check(out) + out[4:])
        out = "".join(c if c == " " else next(left) for c in value)
    elif kind == "ip6":
        out = permuted(value, [DIGITS + "abcdef" if c != ":" else None for c in value], key, tweak)
    else:
        head = re.match(r"AKIA|gh[pousr]_", value)
        classes = _classes(value)
        out = permuted(value, [None if head and i < head.end() else c for i, c in enumerate(classes)], key, tweak)
    if attempt >= GIVE_UP:   # the format may have no free value left
        more = _number(key, "more", kind, normal(kind, value), attempt)
        out += ("" if kind in NUMBERS or kind == "iban" else "-") + str(more)[:attempt]
    return out


def normal(kind: str, value: str) -> str:
    """One spelling for mentions of the same entity."""
    if kind in NUMBERS:
        return ("+" if value.startswith("+") else "") + "".join(c for c in value if c in DIGITS)
    if kind == "iban":
        return value.replace(" ", "")
    return value.lower() if kind in ("email", "ip6") or kind.startswith("given") or kind == "surname" else value


def replaced(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[dict]]:
    """The text with surrogates, and what stands where in it."""
    parts, spans, last, size = [], [], 0, 0
    for start, end, kind, value in detect(text):
        own = normal(kind, value)
        new = surrogate(kind, value if kind in NUMBERS or kind == "iban" else own, key, attempts.get((kind, own), 0))
        if kind != "email" and value.isupper() and not new.isupper():
            new = new.upper()
        parts += [text[last:start], new]
        size += start - last
        spans.append({"kind": kind, "start": size, "end": size + len(new)})
        size += len(new)
        last = end
    return "".join([*parts, text[last:]]), spans


def moved(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``kind, value, attempt`` of the distinct entities that a collision moved past attempt 0."""
    schema = arrow_schema(ENTITY)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {(k, normal(k, v)) for t in batch["text"].to_pylist() if t for _, _, k, v in detect(t)}
            yield pa.RecordBatch.from_pylist([{"kind": k, "value": v} for k, v in sorted(seen)], schema=schema)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [normal(k, surrogate(k, v, key, a)) for k, v, a in zip(batch["kind"].to_pylist(), batch["value"].to_pylist(), batch["attempt"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["kind", "value", "attempt", "surrogate"])

    entities = saved(docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(read, ENTITY).distinct(), "entities")
    real = entities.select("kind", F.col("value").alias("surrogate"))
    active, settled, attempt = entities, None, 0
    while True:
        tried = saved(active.select("kind", "value", F.lit(attempt).alias("attempt")).mapInArrow(replace, "kind string, value string, attempt int, surrogate string"), "surrogates")
        # free: no entity of the corpus, of no other entity before, and of the smallest of those that try it now
        free = tried.join(real, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        firsts = free.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        won = saved(firsts.withColumn("attempt", F.lit(attempt)), "settled")
        settled = won if settled is None else settled.unionByName(won)
        active = saved(tried.join(won.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value"), "clashes")
        if active.isEmpty():
            return settled.filter("attempt > 0").select("kind", "value", "attempt")
        attempt += 1


def anonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_entities, entities`` of every document; ``entities`` are places in the new text."""
    again = saved(moved(docs, key, text_col), "moved")
    n = again.count()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out_ddl = "doc_id bigint, text string, n_entities int, entities array<struct<kind:string,start:int,end:int>>"
    schema = arrow_schema(out_ddl)
    few = {(r.kind, r.value): r.attempt for r in again.collect()} if n <= MAX_BROADCAST else None
    shared = docs.sparkSession.sparkContext.broadcast(few)
    if few is None:   # too many to send to every task: each document gets its own
        def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [{"doc_id": i, "kind": k, "value": v} for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) if t
                         for k, v in sorted({(k, normal(k, v)) for _, _, k, v in detect(t)})]
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

        arrow = arrow_schema("doc_id bigint, kind string, value string")
        own = rows.mapInArrow(mentions, "doc_id bigint, kind string, value string").distinct().join(again, ["kind", "value"])
        own = own.groupBy(F.col("doc_id").alias("own_id")).agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("moved"))
        rows = rows.join(own, F.col("doc_id").eqNullSafe(F.col("own_id")), "left").drop("own_id")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moves = batch["moved"].to_pylist() if shared.value is None else [None] * batch.num_rows
            texts, spans = [], []
            for t, mv in zip(batch["text"].to_pylist(), moves, strict=True):
                attempts = shared.value if shared.value is not None else {(m["kind"], m["value"]): m["attempt"] for m in mv or ()}
                new, places = replaced(t, key, attempts) if t else (t, [])
                texts.append(new)
                spans.append(places)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string()), pa.array([len(s) for s in spans], pa.int32()),
                                              pa.array(spans, schema.field("entities").type)], schema=schema)

    return rows.mapInArrow(apply, out_ddl)
