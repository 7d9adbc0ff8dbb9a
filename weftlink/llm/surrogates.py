"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

Each value is permuted within the strings of its own format by a keyed Feistel network over a mixed radix, conjugated
with a step by one: a bijection that leaves nothing in place. So equal values get equal surrogates in every document
(coreference) and different values different ones (distinctness), without a table of what has been seen and whatever else
a text holds. Names come from lists by gender and script. The first half of a list is what texts mostly hold; it goes by a
keyed permutation to the second half, the second half to pairs of its names, pairs to triples, and so on.
`collisions` checks a corpus for surrogates that stand for two values.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Given names and family names by script and gender, the second half for surrogates; words before a name; honorifics by gender.
GIVEN = {
    ("latin", "f"): "Anna Maria Emma Laura Julia Sarah Clara Sophie Elena Lucia Carmen Marie Claire Camille Ingrid Helga Alice Emily Mary Linda Priya Ananya Fatima Aisha Leila Mei Yuki Sakura Edith Harriet Beatrice Rosalind Winifred Matilda Josephine Henriette Mathilde Adelheid Gudrun Sigrid Astrid Dolores Pilar Rosario Ximena Odette Solange Yvette Lakshmi Kavya Zainab Noor Yasmin Lihua Haruka Chiyo",
    ("latin", "m"): "John James Robert Michael William David Thomas Peter Paul Martin Carlos Miguel Pedro Javier Pierre Jacques Louis Hans Klaus Stefan Wei Jun Raj Arjun Mohammed Ahmed Omar Hiroshi Arthur Edmund Gilbert Leopold Ludwig Otto Rudolf Siegfried Gustav Konrad Alfonso Ignacio Rodrigo Gonzalo Lorenzo Armand Gaston Marcel Thierry Benedict Bowen Kang Sanjay Vikram Ibrahim Yusuf Tariq Kenji",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия Варвара Галина Зинаида Клавдия Лидия Людмила Надежда Раиса Тамара Фаина",
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Владимир Павел Аркадий Борис Вадим Геннадий Григорий Евгений Захар Леонид Руслан Фёдор",
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Σοφία Άννα Ιωάννα Ειρήνη Δήμητρα Αθηνά Βασιλική Γεωργία Ευαγγελία Ζωή Θεοδώρα Καλλιόπη Παρασκευή",
    ("greek", "m"): "Γεώργιος Ιωάννης Δημήτριος Νικόλαος Κωνσταντίνος Παναγιώτης Βασίλειος Χρήστος Αθανάσιος Ανδρέας Απόστολος Ευάγγελος Θεόδωρος Μιχαήλ Σπυρίδων Στέφανος",
}
FAMILY = {
    "latin": "Smith Jones Taylor Brown Wilson Walker Wright Robinson Thompson Hughes Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann García Fernández González Rodríguez López Martínez Sánchez Pérez Dubois Durand Moreau Laurent Lefebvre Bernard Ashworth Barlow Cartwright Dawson Ellison Fletcher Gibbons Hargreaves Ingram Kendall Langley Merritt Neumann Vogel Krüger Lehmann Schuster Winkler Zimmermann Aguilar Cabrera Delgado Espinoza Herrera Mendoza Navarro Beaumont Chevalier Delacroix Fontaine Girard Marchand",
    "cyrillic": "Иванов Петров Сидоров Смирнов Кузнецов Попов Васильев Соколов Михайлов Новиков Аксёнов Борисов Воробьёв Горбунов Данилов Ефимов Жуков Зайцев Кириллов Лебедев",
    "greek": "Παπαδόπουλος Οικονόμου Γεωργίου Αντωνίου Δημητρίου Νικολάου Ιωάννου Βασιλείου Αγγελόπουλος Αλεξίου Δημόπουλος Καραγιάννης Κωνσταντίνου Μακρής Σταματίου Χατζής",
}
CUES = ("[Mm]y name is", "[Nn]ame:", "[Cc]ontact", "[Cc]ontact:", "Dear", "[Ss]igned by", "Signed,", "Sincerely,", "Regards,", "Kontakt:", "Nombre:", "Nom:", "Contacto:")
HONORIFIC = {"m": "Mr Herr Señor Monsieur Sir", "f": "Mrs Ms Miss Frau Señora Señorita Madame Mme Mlle", "": "Dr Prof"}
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")

PUNCTUATION = "!#$%&()*+-./:=?@[\\]^_`{|}~"
#: Letters and digits under which a secret's marks are permuted too.
FEW = 6
_CLASS = {c: (a, k) for a in ALPHABETS for k, c in enumerate(a)}
_LISTS = {k: names.split() for k, names in (GIVEN | FAMILY).items()}
_GIVEN = {n for names in GIVEN.values() for n in names.split()}
_LISTED = {n: (k, i) for k, names in _LISTS.items() for i, n in enumerate(names)}
_TITLE = {t: g for g, ts in HONORIFIC.items() for t in ts.split()}
_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆ-Ώ][a-zß-öø-ÿа-яёα-ωά-ώA-Z'’-]+"
NAMED = re.compile(
    rf"(?<!\w)(?:(?P<title>{'|'.join(sorted(_TITLE, key=len, reverse=True))})\.?[ ](?P<a>{_NAME})(?:[ ](?P<b>{_NAME}))?"
    rf"|(?P<given>{'|'.join(sorted(_GIVEN, key=len, reverse=True))})[ ](?P<family>{_NAME})"
    rf"|(?:{'|'.join(CUES)})[ ](?P<first>{_NAME})[ ](?P<last>{_NAME}))(?!\w)"
)
EMAIL = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}")
SECRET = re.compile(r"(?ai:\b(?:api[_-]?key|access[_-]?key|secret|token|password|passwd|pwd)\b[\"']?\s*[=:]\s*[\"']?)(?P<v>[^\s\"',;<>]{6,})|(?P<w>\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9]{20,}\b)")
NUMBER = re.compile(
    r"(?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d.]*\d))"
    r"|(?P<card>(?<![\d-])(?:\d{4}([ -]?)\d{4}\4\d{4}\4\d{4}|3[47]\d{2}([ -]?)\d{6}\5\d{5}|\d{13,15}|\d{17,19})(?![\d-]*\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]*\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{3}[ .-]\d{3,4}(?:[ .-]\d{2,4}){0,2}(?!\d)|(?<!\w)\+\d{8,15}(?!\d))"
)
GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}"
IP6 = re.compile(rf"(?<![\w:.])(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|(?:{GROUPS})?::(?:{GROUPS})?)(?![\w:])")
DIGIT = re.compile(r"\d{3}|\d\.\d")
HINTS = ("token", "secret", "key", "passw", "pwd", "akia", "gh", "sk-")


def _network(x: int, n: int, key: bytes, tweak: str, back: bool) -> int:
    """A keyed bijection of 0 .. n - 1, or its inverse: an alternating Feistel network over a * b >= n, walked until it
    falls below n."""
    a = isqrt(n - 1) + 1
    b = -(-n // a)
    sign, size = -1 if back else 1, n.bit_length() // 8 + 1
    base = hashlib.blake2b(f"{tweak}|{n:x}|".encode(), key=key, digest_size=32)
    while True:
        left, right = x % a, x // a
        for r in range(7, -1, -1) if back else range(8):
            half = right if r % 2 == 0 else left
            h = base.copy()
            h.update(bytes([r]) + half.to_bytes(size, "big"))
            f = sign * int.from_bytes(h.digest(), "big")
            if r % 2 == 0:
                left = (left + f) % a
            else:
                right = (right + f) % b
        x = left + a * right
        if x < n:
            return x


def permute(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed bijection of 0 .. n - 1 that leaves nothing in place where n > 1: the network, one step on, and back."""
    if n <= 1:
        return 0
    return _network((_network(x, n, key, tweak, False) + 1) % n, n, key, tweak, True)


@functools.cache
def alphabet(c: str) -> str:
    """The characters that c may become: a listed alphabet, or those of its 128 code points with its category; of
    spaces, marks and controls none but itself."""
    if c in _CLASS:
        return _CLASS[c][0]
    kind = unicodedata.category(c)
    if c.isascii() or kind[0] in "ZCP":
        return c
    low = ord(c) & ~127
    return "".join(x for x in map(chr, range(low, low + 128)) if unicodedata.category(x) == kind and x not in _CLASS)


def scramble(value: str, key: bytes, tweak: str, keep: int = 0, marks: bool = False) -> str:
    """Another string of the same format: each character after the first `keep` stays in its alphabet; marks too if
    asked for. A bijection of the strings of one format."""
    sets = [PUNCTUATION if marks and c in PUNCTUATION else alphabet(c) for c in value[keep:]]
    total, x = 1, 0
    for c, own in zip(value[keep:], sets, strict=True):
        x, total = x * len(own) + own.index(c), total * len(own)
    form = value[:keep] + "".join(own[0] for own in sets)
    y, out = permute(x, total, key, f"{tweak}|{form}"), []
    for own in reversed(sets):
        y, k = divmod(y, len(own))
        out.append(own[k])
    return value[:keep] + "".join(reversed(out))


def luhn(digits: str) -> int:
    """0 for a number with a right check digit; otherwise what the digit is off by."""
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10


def _refill(value: str, digits: str) -> str:
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), value)


def card(value: str, key: bytes, tweak: str) -> str:
    """Keeps the first digit, the separators, and how far the check digit is off."""
    d = re.sub(r"\D", "", value)
    off, body = luhn(d), scramble(d[:-1], key, tweak, keep=1)
    return _refill(value, body + str((off - luhn(body + "0")) % 10))


def ip(value: str, key: bytes, tweak: str) -> str:
    n = 0
    for part in value.split("."):
        n = n * 256 + int(part)
    n = permute(n, 1 << 32, key, tweak)
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def ip6(value: str, key: bytes, tweak: str) -> str:
    """Groups of the same number of digits, in the case of the first letter; the place of :: stays."""
    upper = any(c in "ABCDEF" for c in value)
    digits = [c for c in value.lower() if c != ":"]
    form = re.sub("[0-9a-f]", "h", value.lower())
    new = iter(format(permute(int("".join(digits), 16), 16 ** len(digits), key, f"{tweak}|{form}|{upper}"), f"0{len(digits)}x"))
    out = "".join(c if c == ":" else next(new) for c in value)
    return out.upper() if upper else out


def iban(value: str, key: bytes, tweak: str) -> str:
    """Keeps country, spaces, and what the number leaves when divided by 97: 1 for right check digits."""
    out = scramble(value, key, tweak, keep=4)
    if not 2 <= int(value[2:4]) <= 98:  # no check digits are like that; they stay
        return out
    number = lambda v: int("".join(str(int(c, 36)) for c in re.sub(" ", "", v[4:] + v[:4])))
    check = (number(value) - number(out[:2] + "00" + out[4:])) % 97
    return f"{out[:2]}{check + 97 * (check < 2):02d}{out[4:]}"


def email(value: str, key: bytes, tweak: str) -> str:
    """Local part and domain in their format; the top-level domain stays."""
    head, dot, top = value.rpartition(".")
    return scramble(head, key, tweak) + dot + top


def secret(value: str, key: bytes, tweak: str) -> str:
    """A hexadecimal value stays hexadecimal; a known prefix stays. With fewer than FEW letters or digits its marks
    become others too."""
    if re.fullmatch(r"[0-9a-f]+", value):
        return format(permute(int(value, 16), 16 ** len(value), key, f"{tweak}|hex{len(value)}"), f"0{len(value)}x")
    prefix = re.match(r"AKIA|gh[pousr]_|sk-", value)
    return scramble(value, key, tweak, prefix.end() if prefix else 0, sum(len(alphabet(c)) > 1 for c in value) < FEW)


def _place(value: str) -> tuple[object, int, int, str] | None:
    """List, level, index and ending of a listed name: level 0 is the first half of a list, level m > 0 has m names of
    the second half in their order there, with hyphens. Russian feminine family names are the listed ones and an ending."""
    for base, ending in ((value, ""), (value[:-1], "а")) if value.endswith("а") else ((value, ""),):
        found = [_LISTED.get(part) for part in base.split("-")]
        if None in found or ending and found[0][0] != "cyrillic":
            continue
        kind, first = found[0]
        half = len(_LISTS[kind]) // 2
        if first < half and len(found) == 1:
            return kind, 0, first, ending
        if all(f == (kind, half + (first - half + t) % half) for t, f in enumerate(found)):
            return kind, len(found), first - half, ending
    return None


def person(value: str, key: bytes, tweak: str) -> str:
    """A listed name goes to the next level of its list, so that it keeps gender and script. Others are scrambled, and
    never become a listed one. One-to-one."""
    place = _place(value)
    if place:
        kind, level, k, ending = place
        names = _LISTS[kind]
        half = len(names) // 2
        k = permute(k, half, key, f"{tweak}|{kind}|{level}")
        return "-".join(names[half + (k + t) % half] for t in range(level + 1)) + ending
    out = scramble(value, key, tweak)
    while _place(out):
        out = scramble(out, key, tweak)
    return out


MAKE: dict[str, Callable[[str, bytes, str], str]] = {
    "email": email, "secret": secret, "card": card, "ip": ip, "given": person, "family": person,
    "iban": iban, "ip6": ip6, "ssn": scramble, "phone": lambda v, k, t: scramble(v, k, t, keep=len(re.match(r"(?:\+\d{1,3}(?=\D))?", v)[0])),
}


def surrogate(kind: str, value: str, key: bytes) -> str:
    """What stands for a value. One without a character that could become another gets keyed hexadecimal digits."""
    new = MAKE[kind](value, key, kind)
    return new if new != value else hashlib.blake2b(value.encode(), key=key, digest_size=max(8, min(64, len(value) // 2))).hexdigest()


def detect(text: str) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, type), by start; of two that overlap the earlier rule's stays."""
    found: list[tuple[int, int, str]] = []  # kept in order

    def add(start: int, end: int, kind: str) -> None:
        k = bisect.bisect(found, (start, end, kind))
        if (k == 0 or found[k - 1][1] <= start) and (k == len(found) or found[k][0] >= end):
            found.insert(k, (start, end, kind))

    low = text.lower()
    if any(h in low for h in HINTS):
        for m in SECRET.finditer(text):
            add(*m.span("v" if m["v"] else "w"), "secret")
    if "@" in text:
        for m in EMAIL.finditer(text):
            add(*m.span(), "email")
    if DIGIT.search(text):
        for m in NUMBER.finditer(text):
            digits = sum(c.isdigit() for c in m[0])
            if m.lastgroup != "phone" or 7 <= digits <= 15:
                add(*m.span(m.lastgroup), m.lastgroup)
    if "::" in text or text.count(":") >= 7:
        for m in IP6.finditer(text):
            if sum(c != ":" for c in m[0]) >= 4 and any(c.isdigit() for c in m[0]):
                add(*m.span(), "ip6")
    for m in NAMED.finditer(text):
        if m["title"] and not m["b"]:
            add(*m.span("a"), "family")
            continue
        given, family = ("a", "b") if m["title"] else ("given", "family") if m["given"] else ("first", "last")
        add(*m.span(given), "given")
        add(*m.span(family), "family")
    return found


def replace(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and (start, end, type, surrogate) in code points of the original."""
    found = detect(text)
    if not found:
        return text, []
    made = {(kind, text[s:e]): "" for s, e, kind in found}
    for kind, value in made:
        made[kind, value] = surrogate(kind, value, key)
    out, last, spans = [], 0, []
    for s, e, kind in found:
        new = made[kind, text[s:e]]
        out += [text[last:s], new]
        spans.append((s, e, kind, new))
        last = e
    return "".join([*out, text[last:]]), spans


def _replace(key: bytes, column: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string()), ("surrogate", pa.string())]))
        for batch in batches:
            texts, spans = [], []
            for text in batch.column("text").to_pylist():
                new, found = (None, []) if text is None else replace(text, key)
                texts.append(new)
                spans.append([dict(zip(("start", "end", "type", "surrogate"), f, strict=True)) for f in found])
            got = {"text": pa.array(texts, pa.string())} | ({column: pa.array(spans, kind)} if column else {})
            names = [*batch.schema.names, *([column] if column else [])]
            yield pa.RecordBatch.from_arrays([got.get(n) if n in got else batch.column(n) for n in names], names)

    return run


def surrogates(docs: DataFrame, key: bytes = b"demonstration key", column: str | None = "entities") -> DataFrame:
    """docs(doc_id, text, ...) with text replaced and a column of entities added, none if it has no name: array of start,
    end (code points of the original text), type, surrogate. Originals are in no column. Other columns pass through, but
    an own column of that name is replaced. A null text stays null; an empty one and one without an entity stay as they
    are; repeated rows each get a row; no rows give none.
    """
    rest = [c for c in docs.columns if not column or c.lower() != column.lower()]
    kept = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in rest])
    entity = T.StructType().add("start", T.LongType()).add("end", T.LongType()).add("type", T.StringType()).add("surrogate", T.StringType())
    schema = T.StructType([*kept.schema.fields, *([T.StructField(column, T.ArrayType(entity))] if column else [])])
    return kept.mapInArrow(_replace(key, column), schema)


def collisions(found: DataFrame, originals: DataFrame) -> DataFrame:
    """Type and surrogate of which different originals exist: none, if the replacements are distinct.

    found: surrogates(docs); originals: docs. Compares digests, pre-aggregated before the shuffle.
    """
    one = found.select("doc_id", F.explode("entities").alias("e")).join(originals.select("doc_id", F.col("text").alias("raw")), "doc_id")
    pair = one.select("e.type", "e.surrogate", F.sha2(F.expr("substring(raw, e.start + 1, e.end - e.start)"), 256).alias("digest"))
    return pair.groupBy("type", "surrogate").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("type", "surrogate")
