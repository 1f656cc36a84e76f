"""Format-preserving pseudonyms for validated numbers, dates and addresses.

Each value found is checked (Luhn, mod 97, octet range, calendar, numbering plan), ranked within
its format, permuted by a keyed Feistel network with cycle walking, and written back in the same
format. The permutation depends on key and kind alone, so equal values stay linked across
documents and spellings, while nothing can be looked up without the key.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: From so many characters on, texts are permuted in time linear in their length.
LONG = 129
SOME = re.compile(r"[0-9@]|::|AKIA|(?i:passw|pwd|secret|token|key)")
FIND = re.compile(
    r"(?P<email>(?<![\w.+\-])[A-Za-z0-9](?:[A-Za-z0-9._%+\-]{0,63})@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62})(?:\.[A-Za-z0-9\-]{1,63})+)"
    # longer local parts: the run of their characters is read once, from its first possible start
    r"|(?<![A-Za-z0-9._%+\-])(?>(?<!\w)(?=[A-Za-z0-9])|[A-Za-z0-9._%+\-]*?%(?=[A-Za-z0-9]))"
    r"(?P<long>[A-Za-z0-9._%+\-]{65,}+@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62})(?:\.[A-Za-z0-9\-]{1,63})+)"
    # a quoted secret ends at its quote, another one with the characters of a bearer token
    r"|(?P<secret>\bAKIA[0-9A-Z]{16}\b|(?i:\b(?:password|passwd|pwd|secret|token|api_?key)\b[\"']?\s{0,3}[=:]\s{0,3})"
    r"(?:\"(?P<double>(?:[^\"\\\n]|\\.){8,}+)\"|'(?P<single>(?:[^'\\\n]|\\.){8,}+)'|[\"']?(?P<value>[A-Za-z0-9+/_\-][A-Za-z0-9+/_\-.=~]{6,}[A-Za-z0-9+/_\-=~])))"
    r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?P<ipv6>(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,37}::)[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){1,6}(?:::)?)(?![\w:]|\.\d))"
    r"|(?P<date>(?<![\w./\-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\w/\-]|\.\d))"
    r"|(?P<ssn>(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-]))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<card>(?<![\w\-.+])\d(?:[ \-]?\d){12,18}(?!\w|-(?!\d)|\.\d))"
    r"|(?P<phone>(?<![\w.\-])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]?\d{3,4}(?![\w\-]|\.\d)|(?<![\w.\-])\+\d{8,15}(?![\w\-]|\.\d)"
    # groups of other countries: after a country code, after a trunk 0, or nine digits from 6 to 9 on
    r"|(?<![\w.\-])\+\d{1,3}[ .\-](?:\(0?\d{1,4}\)|\d{1,5})(?:[ .\-/]?\d{2,8}){1,5}(?![\w\-]|\.\d)"
    r"|(?<![\w.\-/])0[1-9](?:[ .\-]\d{2}){4}(?![\w\-]|\.\d| \d{2}(?!\d))"
    r"|(?<![\w.\-/])(?:\(0\d{1,4}\)[ /]?|0\d{1,4}(?:/ ?|[ \-]))\d{4,8}(?![\w\-/]|\.\d)"
    r"|(?<![\w.\-])(?:[89]\d[ .\-]\d{3}|[67]\d{2}[ .\-]\d{2})[ .\-]\d{2}[ .\-]\d{2}(?![\w\-]|\.\d| \d{2}(?!\d)))"
)
LOW, HIGH = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def permute(rank: int, size: int, key: bytes, kind: str) -> int:
    """Keyed permutation of 0..size-1: a balanced Feistel network, walked until it lands inside."""
    if size < 2:
        return rank
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    prefix = key + b"\0" + kind.encode() + b"\0" + str(size).encode() + b"\0"
    while True:
        left, right = rank >> half, rank & mask
        for r in range(ROUNDS):
            mixed = hashlib.shake_256(prefix + bytes([r]) + right.to_bytes(width, "big")).digest(width)
            left, right = right, left ^ (int.from_bytes(mixed, "big") & mask)
        rank = left << half | right
        if rank < size:
            return rank


def permute_long(digits: list[int], bases: list[int], key: bytes, kind: str) -> list[int]:
    """Keyed permutation of the strings of digits in the given bases: a Feistel network that adds to each digit of a half."""
    prefix, half = key + b"\0" + kind.encode() + b"\0long" + bytes(bases) + b"\0", len(digits) // 2
    left, right, low, high = digits[:half], digits[half:], bases[:half], bases[half:]
    for r in range(ROUNDS):
        mixed = hashlib.shake_256(prefix + bytes([r]) + bytes(right)).digest(8 * len(left))
        left = [(d + int.from_bytes(mixed[8 * i : 8 * i + 8], "big")) % b for i, (d, b) in enumerate(zip(left, low, strict=True))]
        left, right, low, high = right, left, high, low
    return left + right


def permute_text(text: str, key: bytes, kind: str) -> str:
    """Permute digits among digits and letters among letters of their case; the rest stays."""
    bases = [(48, 10) if "0" <= c <= "9" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else None for c in text]
    out = list(text)
    if len(text) >= LONG:
        spots = [i for i, b in enumerate(bases) if b]
        made = permute_long([ord(text[i]) - bases[i][0] for i in spots], [bases[i][1] for i in spots], key, kind)
        for i, d in zip(spots, made, strict=True):
            out[i] = chr(bases[i][0] + d)
        return "".join(out)
    rank, size = 0, 1
    for c, b in zip(text, bases, strict=True):
        if b:
            rank, size = rank * b[1] + ord(c) - b[0], size * b[1]
    rank = permute(rank, size, key, kind)
    for i in range(len(text) - 1, -1, -1):
        if b := bases[i]:
            rank, at = divmod(rank, b[1])
            out[i] = chr(b[0] + at)
    return "".join(out)


def refill(shape: str, digits: str) -> str:
    """Write digits over the digits of a spelling, keeping its separators."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in shape)


def luhn(digits: str) -> int:
    """Luhn sum modulo 10; 0 for a valid number."""
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def as_email(value: str, key: bytes) -> str | None:
    local, _, host = value.rpartition("@")
    return f"{permute_text(local, key, 'email ' + host.lower())}@{host}"


def as_ip(value: str, key: bytes) -> str | None:
    octets = [int(x) for x in value.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
        return None
    low, high = (1, 223) if 1 <= octets[0] <= 223 else (0, 0) if octets[0] == 0 else (224, 255)
    rank = int.from_bytes(bytes([octets[0] - low, *octets[1:]]), "big")
    got = permute(rank, (high - low + 1) << 24, key, f"ip{low}").to_bytes(4, "big")
    return ".".join(str(x) for x in [got[0] + low, *got[1:]])


def as_ipv6(value: str, key: bytes) -> str | None:
    """Within the addresses that share the first three bits; spelled whole or shortened as the value is."""
    if sum(map(bool, value.split(":"))) < 3:
        return None
    try:
        rank = int(ipaddress.IPv6Address(value))
    except ValueError:
        return None
    top = rank >> 125
    got = ipaddress.IPv6Address(top << 125 | permute(rank & ((1 << 125) - 1), 1 << 125, key, f"ipv6{top}"))
    whole = got.exploded if all(len(x) == 4 for x in value.split(":")) else ":".join(f"{int(x, 16):x}" for x in got.exploded.split(":"))
    new = got.compressed if "::" in value else whole
    return new.upper() if value.upper() == value else new


def as_date(value: str, key: bytes) -> str | None:
    a, b, c = (int(x) for x in re.split(r"\D", value))
    sep = re.search(r"\D", value)[0]
    if len(value.split(sep)[0]) == 4:
        order, parts = "ymd", (a, b, c)
    elif sep == "." or a > 12:
        order, parts = "dmy", (c, b, a)
    else:
        order, parts = "mdy", (c, a, b)
    try:
        day = datetime.date(*parts).toordinal()
    except ValueError:
        return None
    first, last = (LOW, HIGH) if LOW <= day <= HIGH else (1, LOW - 1) if day < LOW else (HIGH + 1, datetime.date.max.toordinal())
    got = datetime.date.fromordinal(first + permute(day - first, last - first + 1, key, "date"))
    width = 2 if all(len(x) > 1 for x in value.split(sep)) else 1  # no zeros in front where the value has none
    fields = {"y": f"{got.year:04d}", "m": f"{got.month:0{width}d}", "d": f"{got.day:0{width}d}"}
    return sep.join(fields[x] for x in order)


def as_ssn(value: str, key: bytes) -> str | None:
    area, group, serial = (int(x) for x in value.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rank, serial = divmod(permute(rank, 898 * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(rank, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def as_iban(value: str, key: bytes) -> str | None:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or mod97(plain) != 1:
        return None
    body = permute_text(plain[4:], key, "iban" + plain[:2])
    check = f"{98 - mod97(plain[:2] + '00' + body):02d}"
    left = iter(plain[:2] + check + body)
    return "".join(c if c == " " else next(left) for c in value)


def as_card(value: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", value)
    if luhn(digits) or digits[0] not in "23456":
        return None
    n = len(digits) - 2
    body = digits[0] + f"{permute(int(digits[1:-1]), 10**n, key, f'card{n}'):0{n}d}"
    return refill(value, body + str(-luhn(body + "0") % 10))


def permute_phone(rest: str, key: bytes, kind: str, refused=lambda digits: False) -> str:
    """Keyed permutation of the numbers of this length that aren't refused, as the given one isn't."""
    while True:
        rest = f"{permute(int(rest), 10 ** len(rest), key, kind):0{len(rest)}d}"
        if not refused(rest):
            return rest


def north_american(digits: str) -> bool:
    return len(digits) == 10 and digits[0] not in "01" and digits[3] not in "01"


def as_phone(value: str, key: bytes) -> str | None:
    """Kept: the country code, and of a number with a trunk 0 the digit after it."""
    digits = re.sub(r"\D", "", value)
    code = re.match(r"\+(\d{1,3})[ .\-(]", value)
    lead = code[1] if code else "1" if value.startswith("+1") and len(digits) == 11 else ""
    rest = digits[len(lead) :]
    if lead in ("", "1") and north_american(rest):
        rank = (int(rest[:3]) - 200) * 800 * 10000 + (int(rest[3:6]) - 200) * 10000 + int(rest[6:])
        rank, line = divmod(permute(rank, 800 * 800 * 10000, key, "phone1"), 10000)
        area, office = divmod(rank, 800)
        return refill(value, f"{lead}{area + 200}{office + 200}{line:04d}")
    if value.startswith("+"):
        if not 8 <= len(digits) <= 15:
            return None
        refused = north_american if lead in ("", "1") else lambda digits: False
        return refill(value, lead + permute_phone(rest, key, f"phone{len(rest)}", refused))
    if digits[0] == "0" and digits[1] != "0" and 9 <= len(digits) <= 12:
        return refill(value, digits[:2] + permute_phone(digits[2:], key, f"trunk{digits[1]}"))
    if len(digits) == 9 and digits[0] in "6789" and len(re.findall(r"\d+", value)) == 4:
        return refill(value, digits[0] + permute_phone(digits[1:], key, f"nine{digits[0]}"))
    return None


MAKERS = {"email": as_email, "ip": as_ip, "ipv6": as_ipv6, "date": as_date, "ssn": as_ssn, "iban": as_iban, "card": as_card, "phone": as_phone}
KINDS = (*MAKERS, "secret")
#: The groups of FIND that hold a value, inner ones first, with their kind.
GROUPS = {"double": "secret", "single": "secret", "value": "secret", "long": "email"} | {k: k for k in KINDS}


@lru_cache(maxsize=65536)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The pseudonym of a value, or None if it isn't valid for its kind."""
    if kind != "secret":
        return MAKERS[kind](value, key)
    if value.startswith("AKIA"):
        return "AKIA" + permute_text(value[4:], key, "secret")
    if re.fullmatch("[0-9a-f]+", value):
        if len(value) >= LONG:
            return "".join(f"{d:x}" for d in permute_long([int(c, 16) for c in value], [16] * len(value), key, "secret"))
        size = 16 ** len(value)
        return f"{permute(int(value, 16), size, key, 'secret'):0{len(value)}x}"
    return permute_text(value, key, "secret")


def ends(kind: str, text: str, start: int, end: int) -> Iterator[int]:
    """Where a value may end: at its match's end; cards and IBANs else after a group before it."""
    yield end
    if kind in ("card", "iban"):
        yield from (i for i in range(end - 1, start, -1) if text[i] in " -")


def pseudonymise(text: str | None, key: bytes) -> tuple[str | None, list[tuple[str, int, int]]]:
    """(text with pseudonyms, spans (kind, start, end) in the given text).

    Values are taken from left to right; where kinds overlap the one that starts first holds, of
    those that start together the first named in FIND that is valid.
    """
    if not text or not SOME.search(text):
        return text, []
    spans, parts, done, at = [], [], 0, 0
    while m := FIND.search(text, at):
        kind, group = next((k, g) for g, k in GROUPS.items() if m[g] is not None)
        start, last = m.span(group)
        for end in ends(kind, text, start, last):
            make = pseudonym if end - start < LONG else pseudonym.__wrapped__  # long values don't fill the cache
            if (new := make(kind, text[start:end], key)) is not None:
                break
        else:  # another kind may start inside
            at = m.start() + 1
            continue
        spans.append((kind, start, end))
        parts += [text[done:start], new]
        done = at = end
    return "".join(parts) + text[done:], spans


def pseudonymise_documents(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, text with pseudonyms, n_values and spans.

    Null texts stay null, empty ones empty, both without spans. Ids may be null. Repeated rows give
    repeated rows with the same pseudonyms, an empty table none. Texts of any length are read whole,
    in time linear in them. The id can't be called n_values or spans; other columns don't take part.
    """
    schema = (
        f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{text_col}` string, n_values long, "
        "spans array<struct<kind:string,start:int,`end`:int>>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            made = [pseudonymise(t, key) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([t for t, _ in made], pa.string()),
                    pa.array([len(s) for _, s in made], pa.int64()),
                    pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in made], kind),
                ],
                names=[id_col, text_col, "n_values", "spans"],
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
