"""Format-preserving pseudonyms: validated numbers, dates, addresses and secrets are permuted within their own format by
a keyed Feistel network, so that a value becomes the same pseudonym in every document, whatever its separators.

Found: payment cards (13 to 19 digits, Luhn), IBANs (mod 97), social security numbers, telephone numbers (North American;
with + or 00 and a country's code; French pairs), IPv4 addresses, e-mail addresses (the part before the @; the domain
stays), dates from 1900 to 2099, and secrets: hexadecimal ones of 32 digits or more, keys with a known beginning (SECRETS),
JSON web tokens, PEM private keys. A pseudonym passes its format's own check: a card Luhn, an IBAN mod 97, a social
security number its ranges. What is not valid stays. No value of two characters' choice or more is its own pseudonym.

Dates are permuted among those with as many digits in day and month and with the day on the same side of 12, so every way
of writing them keeps its shape and its order of day and month, and one date in two formats stays one date. A date whose
day and month can't be told apart is read day first.

Digits or capitals beside a value don't hide it: where the longest candidate fails its check, shorter ends are tried (an
IBAN's by its country's length), then later starts, token by token. A card that is only a part of a run of digits must
be written in one piece or in usual groups (fours, or 4-6-4 and 4-6-5), or any row of figures would hold one by chance.

Edge cases: a null text stays null, an empty one empty; equal rows get equal results; an empty table stays empty; other
columns pass through unread, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import secrets
from collections.abc import Iterator
from datetime import date, timedelta
from functools import cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.shared import fresh

ROUNDS = 8
FIRST_YEAR, YEARS = 1900, 200


def date_class(month: int, day: int) -> tuple[bool, bool, bool]:
    """What the ways of writing a date show of it: digits of the month and of the day, and which of them is surely the day."""
    return month > 9, day > 9, day > 12


@cache
def alike(which: tuple[bool, bool, bool]) -> list[tuple[int, int, int]]:
    """All dates of a class, in order."""
    first = date(FIRST_YEAR, 1, 1)
    days = (first + timedelta(days=n) for n in range((date(FIRST_YEAR + YEARS, 1, 1) - first).days))
    return [(x.year, x.month, x.day) for x in days if date_class(x.month, x.day) == which]

#: How keys of well-known services begin and what follows.
SECRETS = {
    "AKIA": "AKIA[0-9A-Z]{16}", "ASIA": "ASIA[0-9A-Z]{16}", "ghp_": "gh[opsur]_[0-9A-Za-z]{36,}", "github_pat_": "github_pat_[0-9A-Za-z_]{22,}", "glpat-": "glpat-[0-9A-Za-z_-]{20,}",
    "sk-": "sk-[0-9A-Za-z_-]{20,}", "sk_live_": "[sr]k_(?:live|test)_[0-9A-Za-z]{16,}", "xoxb-": "xox[abprs]-[0-9A-Za-z-]{10,}", "AIza": "AIza[0-9A-Za-z_-]{35}", "npm_": "npm_[0-9A-Za-z]{36}",
}
PREFIX = re.compile("AKIA|ASIA|gh[opsur]_|github_pat_|glpat-|sk-|[sr]k_(?:live|test)_|xox[abprs]-|AIza|npm_")
#: Country codes of one and two digits; all others have three.
CODES = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"}
CHUNK = 40  # characters that are permuted as one number

PATTERN = re.compile(
    r"""(?P<email>[\w.+%-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)
      | (?P<pem>-----BEGIN\ [A-Z ]*PRIVATE\ KEY-----[A-Za-z0-9+/=\s:,.-]+?-----END\ [A-Z ]*PRIVATE\ KEY-----)
      | (?P<jwt>(?<![0-9A-Za-z_-])eyJ[0-9A-Za-z_-]{5,}\.eyJ[0-9A-Za-z_-]{5,}\.[0-9A-Za-z_-]{10,})
      | (?P<token>(?<![0-9A-Za-z_-])(?:@SECRETS@)(?![0-9A-Za-z]))
      | (?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z]))
      | (?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))
      | (?P<day>(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([/.])[0-9]{1,2}\g<-1>[0-9]{4})(?![0-9]|[./-][0-9]))
      | (?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))
      | (?P<abroad>(?<![0-9A-Za-z+])(?:\+|00)[1-9](?:[ .-]?(?:\(0?[0-9]{1,4}\)[ ]?)?[0-9]){7,14}(?![0-9]|[.-][0-9]))
      | (?P<pairs>(?<![0-9A-Za-z.])0[1-9](?:[ .-]?)(?:[0-9]{2}(?P<gap>[ .-])[0-9]{2}(?P=gap)[0-9]{2}(?P=gap)[0-9]{2})(?![0-9]|[ .-][0-9]))
      | (?P<phone>(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|-[0-9]))
      | (?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))
      | (?P<card>(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))""".replace(r"\g<-1>", r"(?P=sep)").replace("([/.])", "(?P<sep>[/.])").replace("@SECRETS@", "|".join(SECRETS.values())),
    re.VERBOSE,
)
TOKEN, DIGITS = re.compile("[0-9A-Za-z]+"), re.compile("[0-9]+")
RUN = re.compile("[0-9]+(?:[ -][0-9]+)*")
IBAN_LENGTHS = {c: int(n) for n, cs in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,CR,HR,LI,LV 22:BG,BH,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL "
    "24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split()) for c in cs.split(",")}  # fmt: skip
MAY = re.compile(r"[0-9@]|[0-9a-fA-F]{32}|PRIVATE KEY-----|eyJ|gh[opsur]_|xox[abprs]-|github_pat_|glpat-|sk[-_]|rk_|npm_|AKIA|ASIA|AIza")


class Feistel:
    """Keyed permutations of 0 .. size-1 for any size: alternating modular additions on the two halves of a number in
    the smallest near-square that holds it, repeated until the result is below size. kind keeps formats apart."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def permuted(self, x: int, size: int, kind: str) -> int:
        """x's pseudonym: its image, moved on by a keyed step, and taken back: a permutation that leaves nothing where it is."""
        if size < 2:
            return x
        step = 1 + self.noise(ROUNDS, size, kind) % (size - 1)
        return self.walked((self.walked(x, size, kind, 1) + step) % size, size, kind, -1)

    def walked(self, x: int, size: int, kind: str, way: int) -> int:
        """The network's image of x below size, or for way -1 what has x as its image."""
        a = isqrt(size - 1) + 1
        b = -(-size // a)
        while True:
            left, right = divmod(x, b)
            for r in range(0, ROUNDS, 2)[::way]:
                if way > 0:
                    left = (left + self.noise(r, right, kind)) % a
                    right = (right + self.noise(r + 1, left, kind)) % b
                else:
                    right = (right - self.noise(r + 1, left, kind)) % b
                    left = (left - self.noise(r, right, kind)) % a
            x = left * b + right
            if x < size:
                return x

    def noise(self, r: int, half: int, kind: str) -> int:
        return int.from_bytes(hashlib.blake2b(f"{kind}/{r}/{half}".encode(), key=self.key, digest_size=48).digest(), "little")


def luhn_digit(digits: str) -> str:
    """The check digit that follows digits."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def refill(template: str, characters: str, kind: str = "0123456789") -> str:
    """template with its characters of kind replaced in order; separators stay."""
    new = iter(characters)
    return "".join(next(new) if c in kind else c for c in template)


class Pseudonyms:
    """Replaces what PATTERN finds and the format's own check confirms."""

    def __init__(self, key: bytes) -> None:
        self.feistel = Feistel(key)
        self.memory: dict[tuple[str, str], str | None] = {}

    def digits(self, text: str, kind: str) -> str:
        return str(self.feistel.permuted(int(text), 10 ** len(text), f"{kind}{len(text)}")).zfill(len(text))

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = self.digits(digits[:-1], "card")
        return refill(text, body + luhn_digit(body))

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
            return None
        body = self.classes(plain[4:], "iban" + plain[:2])
        return refill(text, plain[:2] + f"{98 - iban_rest(plain[:2] + '00' + body):02d}" + body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")

    def ssn(self, text: str) -> str | None:
        """Areas 001 to 899 but 666, groups from 01, serials from 0001; areas from 900 (taxpayers' numbers) stay among themselves."""
        area, group, serial = (int(x) for x in text.split("-"))
        if area in (0, 666) or group == 0 or serial == 0:
            return None
        first, areas = (900, 100) if area >= 900 else (1, 898)
        place = area - first - (first == 1 and area > 666)
        x = self.feistel.permuted((place * 99 + group - 1) * 9999 + serial - 1, areas * 99 * 9999, f"ssn{first}")
        place, x = divmod(x, 99 * 9999)
        area = place + first + (first == 1 and place + first >= 666)
        return f"{area:03d}-{x // 9999 + 1:02d}-{x % 9999 + 1:04d}"

    def phone(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        return refill(text, digits[:-10] + self.digits(digits[-10:], "phone"))

    def pairs(self, text: str) -> str | None:
        """A French number: what follows its first two digits."""
        digits = re.sub(r"\D", "", text)
        return refill(text, digits[:2] + self.digits(digits[2:], "phone33" + digits[1]))

    def abroad(self, text: str) -> str | None:
        """A number with its country's code, which stays; so does a bracketed zero that is dialled at home alone."""
        trunk = text.find("(0)")
        digits = re.sub(r"\D", "", text if trunk < 0 else text[:trunk] + text[trunk + 3 :])
        start = 2 if text[0] == "0" else 0
        code = next((digits[start : start + n] for n in (1, 2) if digits[start : start + n] in CODES), digits[start : start + 3])
        rest = digits[start + len(code) :]
        if not 6 <= len(rest) <= 12 or len(code) + len(rest) > 15:
            return None
        if code == "1" and len(rest) == 10:
            new = self.digits(rest, "phone")
        elif code == "33" and len(rest) == 9:
            new = rest[0] + self.digits(rest[1:], "phone33" + rest[0])
        else:
            new = self.digits(rest, "phone" + code)
        new = digits[: start + len(code)] + new
        if trunk < 0:
            return refill(text, new)
        before = len(re.sub(r"\D", "", text[:trunk]))
        return refill(text[:trunk], new[:before]) + "(0)" + refill(text[trunk + 3 :], new[before:])

    def ip(self, text: str) -> str | None:
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
            return None
        x = self.feistel.permuted(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
        return ".".join(map(str, x.to_bytes(4, "big")))

    def secret(self, text: str) -> str | None:
        if not re.search(r"[a-fA-F]", text) or not re.search(r"[0-9]", text):
            return None
        x = self.feistel.permuted(int(text, 16), 16 ** len(text), f"secret{len(text)}")
        new = f"{x:0{len(text)}x}"
        return new if text == text.lower() else new.upper()

    def token(self, text: str) -> str | None:
        start = PREFIX.match(text).end()
        return text[:start] + self.classes(text[start:], "token" + text[:start])

    def jwt(self, text: str) -> str | None:
        return ".".join("eyJ" + self.classes(p[3:], "jwt") if p.startswith("eyJ") else self.classes(p, "jwt") for p in text.split("."))

    def pem(self, text: str) -> str | None:
        head, body, tail = re.fullmatch(r"(-----[^-]+-----)(.*?)(-----[^-]+-----)", text, re.S).groups()
        return head + self.classes(body, "pem") + tail

    def day(self, text: str) -> str | None:
        """Dates of four formats; where day and month can't be told apart, the day is taken to come first."""
        parts = [int(p) for p in re.split(r"\D", text)]
        year_first = len(text.split("-")[0]) == 4 and "-" in text
        y, m, d = parts if year_first else (parts[2], parts[1], parts[0])
        swapped = m > 12 and not year_first
        if swapped:
            m, d = d, m
        try:
            date(y, m, d)
        except ValueError:
            return None
        if not FIRST_YEAR <= y < FIRST_YEAR + YEARS:
            return None
        days = alike(date_class(m, d))
        new = days[self.feistel.permuted(bisect.bisect_left(days, (y, m, d)), len(days), f"day{date_class(m, d)}")]
        written_so = (new[0], new[1], new[2]) if year_first else (new[1], new[2], new[0]) if swapped else (new[2], new[1], new[0])
        widths = [len(p) for p in re.split(r"\D", text)]
        return refill(text, "".join(str(n).zfill(w) for n, w in zip(written_so, widths)))

    def email(self, text: str) -> str | None:
        local, at, domain = text.rpartition("@")
        return self.classes(local, "email@" + domain.lower()) + at + domain

    def classes(self, text: str, kind: str) -> str:
        """ASCII letters become letters of their case, digits digits; up to CHUNK characters are one number of mixed base,
        so one changed letter changes all. Of a longer text each chunk's permutation depends on the chunks before it. Case
        doesn't change which letters come out. Other characters stay."""
        out, known = [], ""
        for at in range(0, max(1, len(text)), CHUNK):
            part = text[at : at + CHUNK]
            out.append(self.chunk(part, kind + known))
            known = "/" + hashlib.blake2b((known + part.lower()).encode(), key=self.feistel.key, digest_size=16).hexdigest()
        return "".join(out)

    def chunk(self, text: str, kind: str) -> str:
        bases = [10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 1 for c in text]
        x = size = 0
        for c, base in zip(text, bases):
            x = x * base + (int(c, 36) - (10 if base == 26 else 0) if base > 1 else 0)
            size = (size or 1) * base
        x = self.feistel.permuted(x, max(size, 1), kind + "/" + "".join(c if b == 1 else "9a"[b == 26] for c, b in zip(text, bases)))
        out = []
        for c, base in zip(reversed(text), reversed(bases)):
            x, digit = divmod(x, base)
            out.append(c if base == 1 else str(digit) if base == 10 else chr((97 if c.islower() else 65) + digit))
        return "".join(reversed(out))

    def of(self, kind: str, text: str) -> str | None:
        """The value's pseudonym, or None if its format's check fails."""
        if (kind, text) not in self.memory:
            if len(self.memory) > 100_000:
                self.memory.clear()
            self.memory[kind, text] = getattr(self, kind)(text)
        return self.memory[kind, text]

    def usual_card(self, text: str, spans: list[tuple[int, int]]) -> int | None:
        """The end of the longest valid card in usual groups that starts with the first of these digit runs."""
        best, sizes = None, []
        for start, end in spans:
            sizes.append(end - start)
            if sum(sizes) > 19:
                break
            usual = len(sizes) == 1 or sizes in ([4, 6, 4], [4, 6, 5]) or (set(sizes[:-1]) == {4} and sizes[-1] <= 4)
            if sum(sizes) >= 13 and usual and self.of("card", text[spans[0][0] : end]) is not None:
                best = end
        return best

    def end_of(self, kind: str, text: str, start: int, end: int, inside: bool) -> int | None:
        """Where the value ends that starts at start, if any; end: the longest candidate's; inside: of one that failed."""
        if kind == "card":
            near = text[start : start + 100]  # a candidate has 37 at most
            spans = [(start + m.start(), start + m.end()) for m in DIGITS.finditer(RUN.match(near).group())]
            if len(near) == 100 and spans[-1][1] == start + 100:
                spans.pop()  # cut
            best = self.usual_card(text, spans)
            if best is not None or inside or self.of(kind, text[start:end]) is None:
                return best
            hides = any(self.usual_card(text, spans[i:]) is not None for i in range(1, len(spans)) if spans[i][0] < end)
            return None if hides else end
        if self.of(kind, text[start:end]) is not None:
            return end
        if kind == "iban":
            length = IBAN_LENGTHS.get(text[start : start + 2])
            ends = [m.end() for m in re.finditer("[A-Z0-9]", text[start:end])]
            groups = [m.end() for m in TOKEN.finditer(text[start:end])]
            for cut in ends[length - 1 : length] if length else groups[-2::-1]:
                if self.of(kind, text[start : start + cut]) is not None:
                    return start + cut
        return None

    def replaced(self, text: str) -> tuple[str, int]:
        """The text with pseudonyms, and how many."""
        if not MAY.search(text):
            return text, 0
        out, at, n, pos, failed = [], 0, 0, 0, 0
        while m := PATTERN.search(text, pos):
            kind = {"sep": "day", "gap": "pairs"}.get(m.lastgroup, m.lastgroup)
            end = self.end_of(kind, text, m.start(), m.end(), m.start() < failed)
            if end is None:
                pos = (TOKEN.match(text, m.start()) or TOKEN.search(text, m.start())).end()
                if m.start() >= failed:
                    failed = m.end()
            else:
                out += [text[at : m.start()], self.of(kind, text[m.start() : end])]
                at = pos = end
                n += 1
        return ("".join([*out, text[at:]]), n) if n else (text, 0)


def session_key(spark: SparkSession) -> bytes:
    """The key of spark.palimpsest.pii.secret, which whoever runs the job sets and keeps; where it is unset, one drawn at
    random for this session, so pseudonyms can't be inverted by others and don't link to those of another session."""
    secret = spark.conf.get("spark.palimpsest.pii.secret", None)
    if not secret:
        secret = secrets.token_hex(32)
        spark.conf.set("spark.palimpsest.pii.secret", secret)
    return secret.encode()


def pseudonymised(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with pseudonyms in text_col; count_col: the name of a further column for their number, with underscores behind
    it if docs has one of that name."""
    at = docs.columns.index(text_col)
    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    count_col = count_col and fresh(docs, count_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            done: list[tuple[str | None, int]] = [names.replaced(t) if (t := x.as_py()) is not None else (None, 0) for x in batch.column(at)]
            arrays = list(batch.columns)
            arrays[at] = pa.array([t for t, _ in done], pa.string())
            extra = [pa.array([n for _, n in done], pa.int64())] if count_col else []
            yield pa.RecordBatch.from_arrays(arrays + extra, names=batch.schema.names + [count_col] * len(extra))

    return docs.mapInArrow(run, columns + (f", `{count_col}` long" if count_col else ""))
