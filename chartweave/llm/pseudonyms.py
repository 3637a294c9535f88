"""Format-preserving pseudonyms: private values are permuted within their format by a keyed Feistel network.

Numbers are validated first (check digits, octets, calendar), so look-alikes stay as they are. A value's
pseudonym depends on its kind, its canonical form and the key alone, so equal values stay linked across
documents whatever their separators, and who has the key can go back. Only a card or IBAN that has digits or
capitals behind it goes through the permutation again while the two together would pass as a longer value.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import ipaddress
import re
import secrets
import warnings
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, with_arrow

ROUNDS = 10
#: The forms that are looked for, in order of precedence.
FORMS = {
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "email": r"(?<![\w.+@-])[\w.+-]*\w@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)(?![A-Za-z_])",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\w/-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}[.-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])",
    "card": r"(?<![\w.,-])\d(?:[ -]?\d){12,18}(?![\w-]|[.,]\d)",
}
#: Lengths of IBANs by country.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
KINDS = list(FORMS)
FOUND = re.compile("|".join(f"(?P<{k}>{v})" for k, v in FORMS.items()))
MAYBE = re.compile(r"[0-9@]|[0-9a-fA-F]{32}")
#: Python writes no longer number than 4300 digits in decimal form.
LONGEST = 10**4300
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def written(n: int) -> str:
    return str(n) if n < LONGEST else f"x{n:x}"


class Feistel:
    """A keyed permutation of 0 .. n-1 for any n, by cycle walking over an even number of bits."""

    def __init__(self, key: bytes):
        self.key = key

    def mixed(self, kind: str, n: int, i: int, half: int, bits: int) -> int:
        raw = hmac.new(self.key, f"{kind}|{written(n)}|{i}|{written(half)}".encode(), hashlib.sha256).digest()
        return int.from_bytes(raw, "big") & ((1 << bits) - 1) if bits <= 256 else int.from_bytes(hashlib.shake_256(raw).digest((bits + 7) // 8), "big") & ((1 << bits) - 1)

    def walk(self, kind: str, n: int, x: int, rounds: range, back: bool) -> int:
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        while True:
            left, right = x >> bits, x & mask
            for i in rounds:
                if back:
                    left, right = right ^ self.mixed(kind, n, i, left, bits), left
                else:
                    left, right = right, left ^ self.mixed(kind, n, i, right, bits)
            x = left << bits | right
            if x < n:
                return x

    def permuted(self, kind: str, n: int, x: int) -> int:
        return x if n < 2 else self.walk(kind, n, x, range(ROUNDS), False)

    def restored(self, kind: str, n: int, x: int) -> int:
        return x if n < 2 else self.walk(kind, n, x, range(ROUNDS - 1, -1, -1), True)


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def filled(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def only_digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def iban_number(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4]))


class Pseudonyms:
    def __init__(self, key: bytes):
        feistel = Feistel(key)
        self.forward, self.back = feistel.permuted, feistel.restored
        self.known = lru_cache(50_000)(self.replaced)

    def replaced(self, kind: str, value: str, back: bool = False) -> str | None:
        """The pseudonym (``back``: the value of a pseudonym); None if the value is not valid."""
        turn = self.back if back else self.forward
        return getattr(self, kind)(value, turn)

    def secret(self, s: str, turn) -> str:
        x = turn("secret", 16 ** len(s), int(s, 16))
        out = f"{x:0{len(s)}x}"
        return out.upper() if s.upper() == s and not s.isdigit() else out

    def email(self, s: str, turn) -> str:
        head, tail = s[: s.rindex(".")], s[s.rindex(".") :]
        # each letter and digit of the address changes within its class; other characters stay
        return self.classes("email", head, turn) + tail

    def classes(self, kind: str, s: str, turn) -> str:
        sets = ["0123456789" if "0" <= c <= "9" else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else "" for c in s]
        n = x = 0
        n = 1
        for c, a in zip(s, sets, strict=True):
            if a:
                n, x = n * len(a), x * len(a) + a.index(c)
        shape = "".join({10: "0", 26: "a"}.get(len(a), c) for c, a in zip(s, sets, strict=True))
        x = turn(f"{kind}|{shape}", n, x)
        out = []
        for c, a in zip(reversed(s), reversed(sets), strict=True):
            if a:
                x, k = divmod(x, len(a))
                c = a[k]
            out.append(c)
        return "".join(reversed(out))

    def iban(self, s: str, turn) -> str | None:
        plain = s.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_number(plain) % 97 != 1:
            return None
        body = self.classes("iban", plain[4:], turn)
        check = 98 - iban_number(plain[:2] + "00" + body) % 97
        it = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(it) for c in s)

    def ip(self, s: str, turn) -> str | None:
        if any(int(x) > 255 for x in s.split(".")):
            return None
        number = int.from_bytes(bytes(map(int, s.split("."))), "big")
        return str(ipaddress.ip_address(turn("ip", 2**32, number)))

    def date(self, s: str, turn) -> str | None:
        """ISO dates, and day or month first with dots or slashes; what only fits one order has that order.

        Days up to the 12th and later ones are permuted among themselves (cycle walking), so that a pseudonym is
        read in the order of its value: different texts get different pseudonyms and all come back, and a date has the same pseudonym
        in every form.
        """
        iso = s[4] == "-"
        orders = [(0, 1, 2)] if iso else [(2, 1, 0), (2, 0, 1)] if s[2] == "." else [(2, 0, 1), (2, 1, 0)]
        parts = [int(x) for x in re.split(r"[./-]", s)]
        for order in orders:
            try:
                day = datetime.date(*(parts[i] for i in order)).toordinal()
            except ValueError:
                continue
            if not FIRST_DAY <= day <= LAST_DAY:
                return None
            early = parts[order[2]] <= 12
            while True:
                day = FIRST_DAY + turn("date", LAST_DAY - FIRST_DAY + 1, day - FIRST_DAY)
                new = datetime.date.fromordinal(day)
                if (new.day <= 12) == early:
                    break
            shown = {order[0]: f"{new.year:04d}", order[1]: f"{new.month:02d}", order[2]: f"{new.day:02d}"}
            digits = "".join(shown[i] for i in range(3))
            return filled(s, digits)
        return None

    def ssn(self, s: str, turn) -> str | None:
        area, group, serial = s.split("-")
        if area in ("000", "666") or area >= "900" or group == "00" or serial == "0000":
            return None
        # areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999
        a = int(area) - 1 - (area > "666")
        x = turn("ssn", 898 * 99 * 9999, (a * 99 + int(group) - 1) * 9999 + int(serial) - 1)
        a, g, n = x // (99 * 9999), x // 9999 % 99, x % 9999
        return f"{a + 1 + (a + 1 >= 666):03d}-{g + 1:02d}-{n + 1:04d}"

    def phone(self, s: str, turn) -> str | None:
        digits = only_digits(s)
        if not 9 <= len(digits) <= 15:
            return None
        code = len(re.match(r"\+(\d*)", s)[1]) if s[0] == "+" else 0
        code = min(code, len(digits) - 7)
        own = digits[code:]
        return filled(s, digits[:code] + f"{turn('phone', 10 ** len(own), int(own)):0{len(own)}d}")

    def card(self, s: str, turn) -> str | None:
        digits = only_digits(s)
        if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        own = f"{turn('card', 10 ** (len(digits) - 1), int(digits[:-1])):0{len(digits) - 1}d}"
        return filled(s, own + str(luhn(own)))

    def accepted(self, kind: str, s: str) -> str | None:
        """The part of a match from its start that is valid: cards and IBANs may have other digits or capitals behind them.

        Parts end at separators. An IBAN has its country's length, if there is such a part; else the longest counts.
        """
        if kind not in ("card", "iban"):
            return s
        parts = [s[:k] for k in range(len(s), 0, -1) if k == len(s) or s[k] in " -"]
        if kind == "iban":
            size = IBAN_LENGTHS.get(s[:2])
            parts.sort(key=lambda x: len(x.replace(" ", "")) != size)  # stable
            return next((x for x in parts if 15 <= len(x.replace(" ", "")) <= 34 and iban_number(x.replace(" ", "")) % 97 == 1), None)
        return next((x for x in parts if len(d := only_digits(x)) >= 13 and luhn(d[:-1]) == int(d[-1]) and len(set(d)) > 1), None)

    def text(self, text: str | None, back: bool = False) -> tuple[str | None, list[int]]:
        """The text with its values replaced, and how many of each kind."""
        counts = [0] * len(KINDS)
        if text is None or not MAYBE.search(text):
            return text, counts

        out: list[str] = []

        def put(m: re.Match, at: int) -> int:
            """Add the text from ``at`` on with the match's value replaced; where to go on."""
            out.append(text[at : m.start()])
            kind, value = m.lastgroup, self.accepted(m.lastgroup, m[0])
            new, rest = self.known(kind, value, back) if value else None, m[0][len(value or "") :]
            while rest and new and self.accepted(kind, new + rest) != new:  # else it would come back as a longer value
                new = self.known(kind, new, back)
            if not new:
                out.append(m[0])
                return m.end()
            counts[KINDS.index(kind)] += 1
            out.append(new)
            return m.start() + len(value)

        at = 0
        while m := FOUND.search(text, at):
            at = put(m, at)
        return "".join([*out, text[at:]]), counts


def count_names(df: DataFrame) -> list[str]:
    """The names that ``with_pseudonyms`` gives its counts: ``n_<kind>``, with underscores behind where ``df`` has that name."""
    return fresh(df, *(f"n_{k}" for k in KINDS))


def with_pseudonyms(df: DataFrame, key: bytes, *, text: str = "text", back: bool = False) -> DataFrame:
    """All columns of ``df`` with the text replaced, and a count for each of KINDS (``count_names``).

    Null and empty texts, and texts without private values, stay as they are; equal rows give equal rows; an empty
    table gives an empty one; texts may have any length. ``back`` restores values with the key.
    """
    names = count_names(df)

    def make():
        pseudonyms = Pseudonyms(key)

        def work(texts):
            rows = [pseudonyms.text(t, back) for t in texts]
            return [*(pa.array([r[1][k] for r in rows], pa.int32()) for k in range(len(KINDS))), pa.array([r[0] for r in rows], pa.string())]

        return work

    out = with_arrow(df, [text], [*(T.StructField(n, T.IntegerType()) for n in names), T.StructField("replaced__", T.StringType())], make)
    return out.select(*(F.col(out.columns[-1]).alias(c) if c == text else F.col(c) for c in df.columns), *names)


#: For demonstration and tests only: who has it can undo the pseudonyms.
DEMONSTRATION_KEY = b"chartweave demonstration key"


def named_key(spark: SparkSession) -> bytes | None:
    said = spark.conf.get("spark.chartweave.pseudonymKey", None)
    local = (spark.sparkContext.master or "").startswith("local")
    return bytes.fromhex(said) if said else DEMONSTRATION_KEY if local else None


def session_key(spark: SparkSession) -> bytes:
    """The key in hexadecimal digits from the session's ``spark.chartweave.pseudonymKey``; only a local session without it gets the demonstration key."""
    key = named_key(spark)
    if key is None:
        raise RuntimeError("set spark.chartweave.pseudonymKey to a secret of hexadecimal digits")
    return key


@lru_cache(None)
def random_key(application: str) -> bytes:
    return secrets.token_bytes(32)


def run_key(spark: SparkSession) -> bytes:
    """``session_key``; on a cluster without the setting a random key, which all queries of the application share and which is stored nowhere.

    Nobody can turn pseudonyms of a random key back or link them to those of another application: who wants that sets a key.
    """
    key = named_key(spark)
    if key is None:
        warnings.warn("spark.chartweave.pseudonymKey is not set: pseudonyms of this application can't be turned back", stacklevel=2)
        key = random_key(spark.sparkContext.applicationId)
    return key


def pseudonym_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, key: bytes | None = None) -> DataFrame:
    """Documents with pseudonyms in the place of private values; ``n_chars``, if there, follows. No row goes.

    Null, empty, repeated and very long texts as in ``with_pseudonyms``. ``key``: ``run_key`` by default.
    """
    out = with_pseudonyms(docs, key or run_key(spark))
    if "n_chars" in docs.columns:
        changed = sum((F.col(n) for n in count_names(docs)), F.lit(0)) > 0
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op10_feistel_pseudonyms(spark: SparkSession, sf_dir: str, key: bytes | None = None) -> DataFrame:
    """Every document's text with pseudonyms, and what was found; ``key``: ``run_key`` by default."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = with_pseudonyms(docs, key or run_key(spark))
    return out.withColumn("n_found", sum((F.col(n) for n in count_names(docs)), F.lit(0)))
