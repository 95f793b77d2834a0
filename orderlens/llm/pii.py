"""PII by format-preserving pseudonyms: a keyed Feistel permutation within each value's format.

Values are found by form and validated first (Luhn, mod 97, calendar, octets, number ranges). Where the longest match fails, shorter
ones, other forms and later starts inside it are tried; what fails them all stays as it is. A
valid value's index among all values of its format is permuted by a balanced Feistel network, walking the cycle
until the result is an index again, and written back in the same form. One key maps equal values to equal pseudonyms,
wherever and however punctuated they occur, so they stay linked; different values stay different.

Telephone numbers are linked by country code and national digits, so +12125550188 and +1 (212) 555-0188 stay one number; dates by day, whatever
the order and mark of their parts, with the month as a number or a name. Where a date of the form 03/04/2021 can be read both ways, the day comes first. Dates with a year of two digits are
linked among themselves, as days from 1970 to 2069. Nine digits without marks are a social security number only behind that name.

Defined results: a null text stays null and has no values; an empty text stays empty; a null id stays null; values that two forms fit belong to the
form that comes first; other columns, whatever their names, are ignored by the query form and kept by mask(); repeated rows repeat their result;
an empty table gives an empty result.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import free

ROUNDS = 10
#: For tests and examples only: whoever reads this can undo the pseudonyms. Production sets a secret of its own in the setting KEY_SETTING.
KEY_SETTING = "spark.orderlens.pii.key"
DEFAULT_KEY = b"orderlens example key"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def key_of(spark: SparkSession) -> bytes:
    """The secret of the setting; without one only a local master runs, with the example key."""
    key = spark.conf.get(KEY_SETTING, None)
    if key:
        return key.encode()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {KEY_SETTING} to a secret of your own")
    return DEFAULT_KEY


@cache
def derived(key: bytes) -> bytes:
    """64 bytes that all of the key goes into; an empty key is refused."""
    if not key:
        raise ValueError("the key for pseudonyms is empty")
    return hashlib.blake2b(key, person=b"orderlens").digest()


def permute(index: int, size: int, key: bytes, form: str) -> int:
    """A keyed permutation of range(size), one for each form."""
    if size < 2:
        return index
    right_size = math.isqrt(size - 1) + 1
    left_size = -(-size // right_size)

    whole_key = derived(key)

    def noise(k: int, half: int, n: int) -> int:
        data = f"{form}|{size}|{k}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=whole_key, digest_size=16 + (n.bit_length() + 7) // 8).digest(), "big") % n

    while True:
        left, right = divmod(index, right_size)
        for k in range(0, ROUNDS, 2):
            left = (left + noise(k, right, left_size)) % left_size
            right = (right + noise(k + 1, left, right_size)) % right_size
        index = left * right_size + right
        if index < size:
            return index


def refill(form: str, digits: str) -> str:
    """Put characters one by one into the places of a text's letters and digits."""
    new = iter(digits)
    return "".join(next(new) if c.isalnum() else c for c in form)


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or digits[0] == "0" or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    # The first digit tells the kind of issuer and stays.
    rest = digits[1:-1]
    body = digits[0] + f"{permute(int(rest), 10 ** len(rest), key, 'card' + digits[0]):0{len(rest)}}"
    return refill(text, body + luhn_digit(body))


def ssn(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    index = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    index, serial = divmod(permute(index, 898 * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(index, 99)
    return refill(text, f"{area + 1 + (area >= 665):03}{group + 1:02}{serial + 1:04}")


def ip(text: str, key: bytes) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255 or any(x != str(int(x)) for x in text.split(".")):
        return None
    new = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, new.to_bytes(4, "big")))


# The country calling codes of one and of two digits; all others have three.
COUNTRY = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
#: Numbers of the North American plan: area and exchange don't start with 0 or 1.
NORTH_AMERICAN = re.compile(r"[2-9]\d\d[2-9]\d{6}")


def phone(text: str, key: bytes) -> str | None:
    """The country code stays. North American numbers are permuted among themselves, with or without the code, all others of a length among the rest."""
    code = "+" + COUNTRY.match(text, 1)[0] if text[0] == "+" else ""
    digits = re.sub(r"\D", "", text[len(code) :])
    if not 7 <= len(digits) <= 12 or code == "+1" and len(digits) != 10:
        return None
    if NORTH_AMERICAN.fullmatch(digits) and code in ("", "+1"):
        area, exchange, line = int(digits[:3]) - 200, int(digits[3:6]) - 200, int(digits[6:])
        index, line = divmod(permute((area * 800 + exchange) * 10_000 + line, 6_400_000_000, key, "phone"), 10_000)
        return code + refill(text[len(code) :], f"{index // 800 + 200}{index % 800 + 200}{line:04}")
    if not code and "(" not in text and not re.search(r"\D", text):
        return None
    if not code and digits[0] == "0":
        # A national number: the 0 before the area stays.
        if not 9 <= len(digits) <= 11:
            return None
        return refill(text, f"0{permute(int(digits[1:]), 10 ** (len(digits) - 1), key, 'phone0'):0{len(digits) - 1}}")
    new = digits
    while True:
        new = f"{permute(int(new), 10 ** len(digits), key, 'phone'):0{len(digits)}}"
        if len(new) != 10 or code not in ("", "+1") or not NORTH_AMERICAN.fullmatch(new):
            return code + refill(text[len(code) :], new)


def new_day(day: datetime.date, key: bytes) -> datetime.date:
    return datetime.date.fromordinal(FIRST_DAY + permute(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))


def date(text: str, key: bytes) -> str | None:
    """Year first, else day first, else month first; parts keep their order, mark and least width."""
    parts = re.split(r"[-/.]", text)
    orders = ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy")
    short = len(parts[0]) < 4 and len(parts[2]) == 2
    for order in orders:
        at = {c: int(parts[order.index(c)]) for c in order}
        if short:
            at["y"] += 1900 if at["y"] >= 70 else 2000
        try:
            day = datetime.date(at["y"], at["m"], at["d"])
        except ValueError:
            continue
        if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
            return None
        if short:
            new = datetime.date.fromordinal(SHORT_FIRST + permute(day.toordinal() - SHORT_FIRST, SHORT_LAST - SHORT_FIRST + 1, key, "short date"))
        else:
            new = new_day(day, key)
        value = {"y": new.year % 100 if short else new.year, "m": new.month, "d": new.day}
        return text[len(parts[0])].join(f"{value[c]:0{len(p)}}" for c, p in zip(order, parts))
    return None


#: Days that two digits of a year stand for.
SHORT_FIRST, SHORT_LAST = datetime.date(1970, 1, 1).toordinal(), datetime.date(2069, 12, 31).toordinal()
# Names of months, by language and length.
MONTHS = [
    "january february march april may june july august september october november december".split(),
    "jan feb mar apr may jun jul aug sep oct nov dec".split(),
    "januar februar m\u00e4rz april mai juni juli august september oktober november dezember".split(),
    "janvier f\u00e9vrier mars avril mai juin juillet ao\u00fbt septembre octobre novembre d\u00e9cembre".split(),
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
]
MONTH_NAMES = "|".join(sorted({n for names in MONTHS for n in names}, key=lambda n: (-len(n), n)))
#: Day, month and year with what stands between: 14 March 2021, 14. M\u00e4rz 2021, 14 de marzo de 2021, March 14, 2021.
NAMED_DATE = rf"(?i:\d{{1,2}}(?:st|nd|rd|th)?\.? (?:de |of )?(?:{MONTH_NAMES})\.?,? (?:de )?\d{{4}}|(?:{MONTH_NAMES})\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}})"
NAMED_PARTS = re.compile(rf"(?i:(?P<name>{MONTH_NAMES})|(?P<year>\d{{4}})|(?P<day>\d{{1,2}})(?P<nth>st|nd|rd|th)?)")


def named_date(text: str, key: bytes) -> str | None:
    """The month's name stays in its language and length, in the case of its first letters."""
    found = {k: v for m in NAMED_PARTS.finditer(text) for k, v in m.groupdict().items() if v}
    name = found["name"].lower()
    # March and mars, april in two languages: the first list that has the name; a longer list wins over a shorter one by its place.
    names = next(n for n in MONTHS if name in n)
    try:
        day = datetime.date(int(found["year"]), names.index(name) + 1, int(found["day"]))
    except ValueError:
        return None
    if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
        return None
    new = new_day(day, key)
    month = names[new.month - 1]
    month = month.upper() if found["name"].isupper() else month.capitalize() if found["name"][0].isupper() else month
    ending = "th" if 10 <= new.day <= 20 else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")

    def written(m: re.Match) -> str:
        return month if m["name"] else f"{new.year:04}" if m["year"] else f"{new.day:0{len(m['day'])}}" + (ending if m["nth"] else "")

    return NAMED_PARTS.sub(written, text)


def ip6(text: str, key: bytes) -> str | None:
    """Written in the shortest form, in the letters' case. Without any digit (a::b) it is code rather than an address."""
    if not re.search(r"\d", text):
        return None
    try:
        value = int(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    if not value:
        return None
    new = str(ipaddress.IPv6Address(permute(value, 1 << 128, key, "ip6")))
    return new.upper() if text.isupper() else new


@cache
def letters_like(c: str) -> tuple[str, str] | None:
    """A name for a character's kind and all characters of it: digits, Latin letters of a case, or letters of a case from the same 64 code points; None for other signs."""
    for name, letters in (("0", "0123456789"), ("a", "abcdefghijklmnopqrstuvwxyz"), ("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")):
        if c in letters:
            return name, letters
    if not c.isalnum():
        return None
    block, case = ord(c) >> 6, (c.islower(), c.isupper(), c.isalpha())
    letters = "".join(x for x in map(chr, range(block << 6, (block + 1) << 6)) if x.isalnum() and (x.islower(), x.isupper(), x.isalpha()) == case)
    return f"<{block:x}{'lu'[case[1]] if case[0] or case[1] else 'n' if not case[2] else 'o'}>", letters


def by_character(text: str, key: bytes, form: str) -> str:
    """Letters and digits permuted together, each within its kind; all else stays."""
    kinds = [letters_like(c) for c in text]
    index, size = 0, 1
    for c, kind in zip(text, kinds):
        if kind:
            index, size = index * len(kind[1]) + kind[1].index(c), size * len(kind[1])
    index, out = permute(index, size, key, form + "".join("-" if not k else k[0] for k in kinds)), []
    for c, kind in zip(reversed(text), reversed(kinds)):
        if kind:
            index, at = divmod(index, len(kind[1]))
            c = kind[1][at]
        out.append(c)
    return "".join(reversed(out))


def iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    as_number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(plain) <= 34 or as_number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = by_character(plain[4:], key, "iban")
    return refill(text, plain[:2] + f"{98 - as_number(body + plain[:2] + '00') % 97:02}" + body)


def email(text: str, key: bytes) -> str:
    """The part before the @ changes; a domain is no person's."""
    name, _, domain = text.rpartition("@")
    return f"{by_character(name, key, 'email')}@{domain}"


def token(text: str, key: bytes) -> str:
    """Keys of services: what names the service stays."""
    lead = TOKEN_LEAD.match(text)[0]
    return lead + by_character(text[len(lead) :], key, "token")


def secret(text: str, key: bytes) -> str:
    """Hexadecimal digits stay hexadecimal ones, in the letters' case."""
    low = text.islower() or text.isdigit()
    new = f"{permute(int(text, 16), 16 ** len(text), key, 'secret'):0{len(text)}x}"
    return new if low else new.upper()


# What keys of services start with.
TOKEN_LEAD = re.compile(r"AKIA|ASIA|gh[pousr]_|sk-(?:[a-z]+-)*|xox[abprs]-")
# What a value of each kind looks like, in the order in which they are tried at a place.
FORMS: dict[str, tuple[str, Callable[[str, bytes], str | None]]] = {
    "email": (r"[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", email),
    "token": (r"(?<![0-9A-Za-z_-])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,255}|sk-[0-9A-Za-z_-]{20,200}|xox[abprs]-[0-9A-Za-z-]{10,200})(?![0-9A-Za-z_-])", token),
    "secret": (r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])", secret),
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", iban),
    "ip": (r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", ip),
    "ip6": (r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])", ip6),
    "date": (
        r"(?<![\w/.-])(?:\d{4}(?P<m1>[-/.])\d{1,2}(?P=m1)\d{1,2}|\d{1,2}(?P<m2>[-/.])\d{1,2}(?P=m2)\d{4}|\d{1,2}/\d{1,2}/\d{2}|\d{2}\.\d{2}\.\d{2}(?!\.\d))(?!(?!T\d\d:)[\w/-])",
        date,
    ),
    "named_date": (rf"(?<![\w/.-]){NAMED_DATE}(?!\w)", named_date),
    "ssn": (r"(?<![\w-])(?:\d{3}(?P<m3>[- ])\d{2}(?P=m3)\d{4}|(?:(?<=SSN )|(?<=SSN: )|(?<=SSN:)|(?<=SSN=)|(?<=SSN#)|(?<=ssn )|(?<=ssn: )|(?<=ssn=)|(?<=[Ss]ecurity [Nn]umber )|(?<=[Ss]ecurity [Nn]umber: ))\d{9})(?![\w-])", ssn),
    "card": (r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)", card),
    "phone": (r"(?<![\w.])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[-.]\d{4}|\d{3}[-.]\d{3}[-.]\d{4}|(?<![/-])[2-9]\d{2}[2-9]\d{6}(?![/-])|0\d{1,4}[ -]\d{3,4}[ -]\d{3,4})(?!\w)", phone),
}
ANY = re.compile("|".join(f"(?P<{kind}>{form})" for kind, (form, _) in FORMS.items()))
ONE = {kind: re.compile(form) for kind, (form, _) in FORMS.items()}
#: Issuers' first digits and lengths. Digits of a failed value of another form pass Luhn by chance one time in ten, so a card among them has to fit an issuer too.
ISSUED = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]|2[2-7])\d{14}|3[47]\d{13}|3[0689]\d{12,17}|35\d{14,17}|(?:6\d|5[06-8])\d{11,17}")
#: Where a value of a form with groups can end before the longest match does.
EDGE = {"iban": re.compile(" "), "card": re.compile("[ -]"), "phone": re.compile(r"(?<=[\d)])[ .-]")}
SIGN = re.compile(r"[0-9@]|" + TOKEN_LEAD.pattern)  # a named date has digits


def valid(match: re.Match, key: bytes, in_other: bool = False) -> tuple[str, int, str] | None:
    """Kind, end and pseudonym of the first valid value at the match's start: forms in order, of each the longest match, then shorter ones that end between groups."""
    text, start = match.string, match.start()
    first = next(k for k in FORMS if match[k] is not None)
    kinds = list(FORMS)
    for kind in kinds[kinds.index(first) :]:
        longest = ONE[kind].match(text, start)
        if not longest:
            continue
        edges = [start + gap.start() for gap in EDGE[kind].finditer(longest[0])] if kind in EDGE else []
        for end in [longest.end(), *reversed(edges)]:
            if (in_other or first != "card") and kind == "card" and not ISSUED.fullmatch(re.sub("[ -]", "", text[start:end])):
                continue
            if end == longest.end() or ONE[kind].fullmatch(text, start, end):
                new = FORMS[kind][1](text[start:end], key)
                if new is not None:
                    return kind, end, new
    return None


def pseudonymise(text: str, key: bytes = DEFAULT_KEY) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind it had."""
    found: dict[str, int] = {}
    if not SIGN.search(text):
        return text, found

    out, done, at, other_end = [], 0, 0, 0
    while match := ANY.search(text, at):
        value = valid(match, key, match.start() < other_end)
        if value is None:
            if match["card"] is None:
                other_end = max(other_end, match.end())
            # What failed can hold a value that starts later.
            at = match.start() + 1
            continue
        kind, end, new = value
        kind = kind.removeprefix("named_")
        found[kind] = found.get(kind, 0) + 1
        out += text[done : match.start()], new
        done = at = end
    return "".join([*out, text[done:]]), found


def mask(docs: DataFrame, text_col: str = "text", key: bytes = DEFAULT_KEY, found_col: str = "found") -> DataFrame:
    """docs with the text pseudonymised, and a column more: kind:number of the values, sorted and joined by commas. No shuffle."""
    (found,) = free(docs, found_col)
    schema = StructType([*docs.schema.fields, StructField(found, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds = [], []
            for text in batch.column(text_col).to_pylist():
                new, n = pseudonymise(text, key) if text is not None else (None, {})
                texts.append(new)
                kinds.append(",".join(f"{k}:{n[k]}" for k in sorted(n)))
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kinds, pa.string())], [*batch.schema.names, found])

    return docs.mapInArrow(run, schema)


def pseudonyms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = DEFAULT_KEY) -> DataFrame:
    """One row per row of docs: id_col, n_values, found, text."""
    out = mask(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")), "text", key)
    total = F.aggregate(F.transform(F.regexp_extract_all("found", F.lit(r":(\d+)"), F.lit(1)), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(id_col, total.alias("n_values"), "found", "text")
