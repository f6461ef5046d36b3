"""Operator 5: format-preserving pseudonyms for personal data, by a keyed Feistel network."""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_rows

ROUNDS = 10


def permute(value: int, size: int, key: bytes, tweak: str, valid: Callable[[int], bool] = lambda _: True) -> int:
    """``value`` under a keyed permutation of the valid numbers below ``size``.

    A Feistel network on two nearly equal factors; results outside the valid
    numbers are permuted again (cycle walking), which keeps it one to one.
    ``value`` must be valid itself.
    """
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)

    def part(r: int, x: int, most: int) -> int:
        raw = f"{tweak}|{size}|{r}|{x}".encode()
        return int.from_bytes(hashlib.blake2b(raw, key=key, digest_size=32).digest(), "big") % most

    while True:
        left, right = divmod(value, b)
        for r in range(0, ROUNDS, 2):
            left = (left + part(r, right, a)) % a
            right = (right + part(r + 1, left, b)) % b
        value = left * b + right
        if value < size and valid(value):
            return value


RADIX = ((re.compile("[0-9]"), "0123456789"), (re.compile("[a-z]"), "abcdefghijklmnopqrstuvwxyz"), (re.compile("[A-Z]"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


#: Characters permuted as one number; longer texts go in blocks, so that the work stays linear.
BLOCK = 64


def permute_text(text: str, key: bytes, tweak: str, alphabet: str | None = None, valid: Callable[[str], bool] | None = None) -> str:
    """``text`` with its ASCII letters and digits permuted as one number, each within its class; other characters stay.

    With ``alphabet`` every character of it is permuted within the alphabet.
    Of a long text each ``BLOCK`` characters are a number; those before are part
    of its tweak, which can be undone from the front, so this is one to one too.
    ``valid`` is for texts of one block.
    """
    if len(text) <= BLOCK:
        return _permute_block(text, key, tweak, alphabet, valid)
    seen, out = hashlib.blake2b(f"{len(text)}".encode(), key=key, digest_size=16), []
    for k in range(0, len(text), BLOCK):
        block = text[k : k + BLOCK]
        out.append(_permute_block(block, key, f"{tweak}|{seen.hexdigest()}", alphabet, None))
        seen.update(block.encode("utf-8", "surrogatepass"))
    return "".join(out)


def _permute_block(text: str, key: bytes, tweak: str, alphabet: str | None, valid: Callable[[str], bool] | None) -> str:
    sets = [alphabet if alphabet and c in alphabet else None if alphabet else next((a for p, a in RADIX if p.fullmatch(c)), None) for c in text]
    value, size = 0, 1
    for c, s in zip(text, sets, strict=True):
        if s:
            value, size = value * len(s) + s.index(c), size * len(s)

    def render(v: int) -> str:
        out = []
        for c, s in zip(reversed(text), reversed(sets), strict=True):
            if s:
                v, k = divmod(v, len(s))
                c = s[k]
            out.append(c)
        return "".join(reversed(out))

    shape = "".join(c if s is None else {"0": "0", "a": "a", "A": "A"}.get(s[0], "x") for c, s in zip(text, sets, strict=True))
    return render(permute(value, size, key, f"{tweak}|{shape}", (lambda v: valid(render(v))) if valid else lambda _: True))


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def with_digits(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    it = iter(digits)
    return re.sub("[0-9]", lambda _: next(it), text)


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(payload)))
    return str(-total % 10)


def _email(text: str, key: bytes) -> str | None:
    """Marks before the name stay outside the address; the name may not end with a full stop."""
    local, _, domain = text.rpartition("@")
    own = local.lstrip("._%+-")
    if not own or own[-1] == ".":
        return None
    name, dot, top = domain.rpartition(".")
    return local[: len(local) - len(own)] + permute_text(own, key, "email") + "@" + permute_text(name, key, "domain") + dot + top


def _ip(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(len(p) > 3 or int(p) > 255 or (p[0] == "0" and p != "0") for p in parts):
        return None
    value = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _card(text: str, key: bytes) -> str | None:
    d = digits_of(text)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = d[0] + permute_text(d[1:-1], key, "card" + d[0])
    return with_digits(text, body + luhn_digit(body))


def _ssn(text: str, key: bytes) -> str | None:
    ok = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    d = digits_of(text)
    return with_digits(text, permute_text(d, key, "ssn", valid=ok)) if ok(d) else None


def _phone(text: str, key: bytes) -> str | None:
    """The last ten digits (or all after a country code of one to three) are permuted; the code and the layout stay."""
    d = digits_of(text)
    if not 8 <= len(d) <= 15:
        return None
    code = len(d) - 10 if len(d) > 10 else (re.match(r"\+([0-9]{1,3})(?![0-9])", text) or [0, ""])[1].__len__()
    national = d[code:]
    first = (lambda x: x[0] in "23456789") if national[0] in "23456789" else (lambda x: x[0] in "01")
    return with_digits(text, d[:code] + permute_text(national, key, "phone", valid=first))


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(text: str, key: bytes) -> str | None:
    """A real date of the years 1900 to 2099; its order (year, day or month first), marks and padding stay.

    Where both readings of 05/04/2024 are dates, the day comes first.  Days of
    the month up to 12 are permuted among themselves, and so are the others, in
    every order: a month-first pseudonym then never reads as a day-first one,
    and a date written in two ways keeps one pseudonym.
    """
    parts = re.split("([-/.])", text)
    a, b, c = parts[0], parts[2], parts[4]
    if parts[1] != parts[3]:
        return None
    for order in ("ymd",) if len(a) == 4 else ("dmy", "mdy"):
        at = {k: int(x) for k, x in zip(order, (a, b, c), strict=True)}
        try:
            day = datetime.date(at["y"], at["m"], at["d"]).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            continue
        alike = lambda v, late=at["d"] > 12: (datetime.date.fromordinal(FIRST_DAY + v).day > 12) == late
        new = datetime.date.fromordinal(FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date", alike))
        short = any(len(x) == 1 for x in (a, b))
        values = {"y": f"{new.year:04d}", "m": str(new.month) if short else f"{new.month:02d}", "d": str(new.day) if short else f"{new.day:02d}"}
        return parts[1].join(values[k] for k in order)
    return None


def _iban_check(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(text: str, key: bytes) -> str | None:
    """Checked and permuted without blanks, which are put back at their places."""
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_check(plain) != 1:
        return None
    body = permute_text(plain[4:], key, "iban" + plain[:2])
    new = iter(f"{plain[:2]}{98 - _iban_check(plain[:2] + '00' + body):02d}{body}")
    return "".join(c if c == " " else next(new) for c in text)


def _aws(text: str, key: bytes) -> str | None:
    return text[:4] + permute_text(text[4:], key, "aws", alphabet="0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _secret(text: str, key: bytes) -> str | None:
    name, mark, value = re.fullmatch(r"(?s)(.*?)(\s*[=:]\s*[\"']?)([^\s\"']+)", text).groups()
    hexes = "0123456789abcdef" if re.fullmatch("[0-9a-f]+", value) else None
    return name + mark + permute_text(value, key, "secret", alphabet=hexes)


def group_ends(text: str) -> Iterator[str]:
    """``text`` and what is left of it without its last groups of letters and digits, longest first."""
    yield text
    for m in reversed(list(re.finditer("[ -]", text))):
        yield text[: m.start()]


@dataclass(frozen=True)
class Kind:
    """A pattern and the pseudonym of what it finds; None from ``change`` leaves a match that is not valid.

    A ``grouped`` match may be read too far, so its shorter readings that end
    with a group are tried too.  A ``valued`` one goes on to the last letter or
    digit before a blank or quote, if there is a digit on the way.
    """

    name: str
    pattern: str
    change: Callable[[str, bytes], str | None]
    grouped: bool = False
    valued: bool = False


VALUE = re.compile(r"[^\s\"']*")
DIGIT = re.compile("[0-9]")


#: Tried in this order at each place.  A run of name characters is read once, from its start: no pattern goes back over it.
KINDS = (
    Kind("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}", _email),
    Kind("aws_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", _aws),
    Kind("secret", r"(?<![A-Za-z])(?i:password|passwd|secret|token|api[_-]?key)[ \t]*[=:][ \t]*[\"']?(?=[^\s\"'])", _secret, valued=True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])", _iban, True),
    Kind("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])", _ip),
    Kind("date", r"(?<![0-9./-])(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})(?![0-9]|[./-][0-9])", _date),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])", _ssn),
    Kind("card", r"(?<![0-9-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", _card, True),
    Kind("phone", r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])", _phone),
)


class Pseudonymizer:
    """Replaces the valid matches of ``kinds`` in a text; equal values get equal pseudonyms under one key."""

    def __init__(self, key: bytes, kinds: tuple[Kind, ...] = KINDS):
        if not 16 <= len(key) <= 64:
            raise ValueError("the key must have 16 to 64 bytes")
        self.kinds = {k.name: k for k in kinds}
        self.pattern = re.compile("|".join(f"(?P<{k.name}>{k.pattern})" for k in kinds))
        self.single = [(k, re.compile(k.pattern)) for k in kinds]
        self.quick = re.compile("[0-9@]")
        self.change = lru_cache(1 << 16)(lambda name, text: self.kinds[name].change(text, key))

    def __call__(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        found: dict[str, int] = {}
        if not text or not self.quick.search(text):
            return text, found
        out, at, begin, bare = [], 0, 0, 0
        while m := self.pattern.search(text, begin):
            # a match that is not valid gives way to the later kinds at the same place
            for kind, pattern in self.single:
                if not (own := pattern.match(text, m.start())):
                    continue
                whole = own[0]
                if kind.valued:
                    if own.end() < bare:  # within a value that was read before and has no digit from there on
                        continue
                    end = VALUE.match(text, own.end()).end()
                    if not DIGIT.search(text, own.end(), end):
                        bare = end
                        continue
                    while not (text[end - 1].isascii() and text[end - 1].isalnum()):
                        end -= 1
                    whole = text[m.start() : end]
                for read in group_ends(whole) if kind.grouped else (whole,):
                    if (new := self.change(kind.name, read)) is not None:
                        break
                else:
                    continue
                out += [text[at : m.start()], new]
                at = begin = m.start() + len(read)
                found[kind.name] = found.get(kind.name, 0) + 1
                break
            else:
                begin = m.start() + 1
        return "".join([*out, text[at:]]) if out else text, found


def pseudonymize(docs: DataFrame, key: bytes, kinds: tuple[Kind, ...] = KINDS, text: str = "text", counts: str | None = "pii") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and pii map<string, long> of the counts by kind.

    Cards and IBANs in groups are read as long as they are valid, so digits that
    follow after a blank (an expiry, a count) stay as they are.
    Numbers are replaced only if valid (Luhn, IBAN check digits, octets, real
    dates); addresses, telephone numbers and secrets by their form.  Null text
    stays null, other columns pass through.  ``counts`` names the column of the
    counts, which replaces one of that name; without it there are none.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != counts])
    kind = pa.map_(pa.string(), pa.int64())

    def run(batches) -> Iterator[pa.RecordBatch]:
        change = Pseudonymizer(key, kinds)
        for batch, texts in text_rows(batches, text):
            done = [change(x) for x in texts]
            columns = [pa.array([d[0] for d in done], pa.string()) if n == text else c for n, c in zip(batch.schema.names, batch.columns, strict=True)]
            if counts:
                columns.append(pa.array([list(d[1].items()) for d in done], kind))
            yield pa.record_batch(columns, names=[*batch.schema.names, *([counts] if counts else [])])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *([f"`{counts}` map<string, long>"] if counts else [])])
    return docs.mapInArrow(run, schema)
