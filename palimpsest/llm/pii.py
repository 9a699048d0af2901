"""Format-preserving pseudonyms for personal data.

Every value that is found and validated is read as a number within its format (digits of
a card without the check digit, days of a calendar date, bits of an address, letters and
digits of a mailbox) and sent through a keyed permutation of exactly that set: a Feistel
network over the next even number of bits, walked until it lands inside again.  The
pseudonym has the same format, separators and letter case, is valid in the same sense
(check digits are computed anew, dates exist), and depends on the value and the key
alone, so equal values stay linked across documents, however they were written.

The same key and code give the same text on every run.  Only the matched spans change.
Whoever has the key can undo the pseudonyms: a session's `spark.palimpsest.pii.key` holds
it, and `KEY`, which this code shows to everybody, is only for tables without secrets.

Dates between 1800 and 2199 are permuted among themselves, other years among the rest.
Not taken for secrets: values after a name such as `token` with fewer than 16 characters
or without a digit.  A text is read once for each kind, in time that grows with its length.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

ROUNDS = 8
#: Characters of a longer value that are permuted together.
RUN = 64
#: The key where none is set; no secret.
KEY = b"palimpsest pseudonyms"
#: The setting that holds the key.
KEY_SETTING = "spark.palimpsest.pii.key"


def permute(x: int, size: int, key: bytes, kind: str) -> int:
    """A keyed permutation of range(size), another one for each kind."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    person = hashlib.blake2b(f"{kind}:{size}".encode(), digest_size=16).digest()
    while True:
        a, b = x >> half, x & mask
        for r in range(ROUNDS):
            f = hashlib.blake2b(bytes([r]) + b.to_bytes(width, "big"), digest_size=width, key=key[:64], person=person)
            a, b = b, a ^ (int.from_bytes(f.digest(), "big") & mask)
        x = a << half | b
        if x < size:
            return x


def _digits(s: str, key: bytes, kind: str) -> str:
    return str(permute(int(s), 10 ** len(s), key, f"{kind}{len(s)}")).zfill(len(s))


def _refill(pattern: str, digits: str) -> str:
    """pattern with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def _only_digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _luhn(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _card(m: re.Match, key: bytes) -> str | None:
    d = _only_digits(m[0])
    if not 13 <= len(d) <= 19 or d[-1] != _luhn(d[:-1]):
        return None
    body = _digits(d[:-1], key, "card")
    return _refill(m[0], body + _luhn(body))


def _phone(m: re.Match, key: bytes) -> str | None:
    number = m["abroad"] or m["national"]
    d = _only_digits(number)
    if not 7 <= len(d) <= 12:
        return None
    return (m["country"] or "") + _refill(number, _digits(d, key, "phone"))


def _ssn(m: re.Match, key: bytes) -> str | None:
    a, g, s = m[0].split("-")
    if a in ("000", "666") or a[0] == "9" or g == "00" or s == "0000":
        return None
    areas = [x for x in range(1, 900) if x != 666]
    n = (areas.index(int(a)) * 99 + int(g) - 1) * 9999 + int(s) - 1
    n = permute(n, len(areas) * 99 * 9999, key, "ssn")
    n, s2 = divmod(n, 9999)
    a2, g2 = divmod(n, 99)
    return f"{areas[a2]:03d}-{g2 + 1:02d}-{s2 + 1:04d}"


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _iban(m: re.Match, key: bytes) -> str | None:
    s = m[0].replace(" ", "")
    if not 15 <= len(s) <= 34 or s[2:4] != _iban_check(s[:2], s[4:]):
        return None
    rest = _mixed(s[4:], key, "iban")
    it = iter(s[:2] + _iban_check(s[:2], rest) + rest)
    return "".join(c if c == " " else next(it) for c in m[0])


def _ip(m: re.Match, key: bytes) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255:
        return None
    n = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


_FIRST, _LAST = date(1800, 1, 1).toordinal(), date(2199, 12, 31).toordinal()


def _day(y: int, m: int, d: int, key: bytes) -> date | None:
    """Another date; common years keep to common years, so that texts stay plausible."""
    try:
        day = date(y, m, d).toordinal()
    except ValueError:
        return None
    common = _LAST - _FIRST + 1
    if _FIRST <= day <= _LAST:
        return date.fromordinal(_FIRST + permute(day - _FIRST, common, key, "date"))
    n = permute(day - 1 if day < _FIRST else day - 1 - common, date.max.toordinal() - common, key, "other date")
    return date.fromordinal(n + 1 if n + 1 < _FIRST else n + 1 + common)


def _iso(m: re.Match, key: bytes) -> str | None:
    y, mo, d = re.split(r"[-/]", m[0])
    out = _day(int(y), int(mo), int(d), key)
    return out and f"{out.year:04d}{m[0][4]}{out.month:02d}{m[0][4]}{out.day:02d}"


def _european(m: re.Match, key: bytes) -> str | None:
    """Day first; where only the other reading is a date, month first."""
    sep = next(c for c in m[0] if not c.isdigit())
    a, b, y = (int(x) for x in m[0].split(sep))
    out, swap = _day(y, b, a, key), False
    if out is None:
        out, swap = _day(y, a, b, key), True
    if out is None:
        return None
    first, second = (out.month, out.day) if swap else (out.day, out.month)
    return f"{first:02d}{sep}{second:02d}{sep}{out.year:04d}"


_ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"]
_RADIX = {c: (a, i) for a in _ALPHABETS for i, c in enumerate(a)}


def _mixed(s: str, key: bytes, kind: str) -> str:
    """Letters and digits permuted together, each staying in its own alphabet; other characters stay."""
    spots, new = [_RADIX[c] for c in s if c in _RADIX], []
    for at in range(0, len(spots), RUN):
        run, n, size, out = spots[at : at + RUN], 0, 1, []
        for a, i in run:
            n, size = n * len(a) + i, size * len(a)
        n = permute(n, size, key, kind + (f"@{at}:" if at else "") + "".join(str(_ALPHABETS.index(a)) for a, _ in run))
        for a, _ in reversed(run):
            n, i = divmod(n, len(a))
            out.append(a[i])
        new += reversed(out)
    it = iter(new)
    return "".join(next(it) if c in _RADIX else c for c in s)


def _hex(s: str, key: bytes) -> str:
    parts = [s[at : at + RUN] for at in range(0, len(s), RUN)]
    return "".join(f"{permute(int(p, 16), 16 ** len(p), key, f'hex{len(s)}' + (f'@{i}' if i else '')):0{len(p)}x}" for i, p in enumerate(parts))


_DOMAIN = re.compile(r"@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")
_MARKS = "._%+-"
_MAILBOX = "".join(_ALPHABETS) + _MARKS


def _emails(text: str):
    """(start, end, mailbox, domain) of every address: each @ looks back and ahead once."""
    last, at = 0, text.find("@")
    while at >= 0:
        head = text[last:at]
        local = head[len(head.rstrip(_MAILBOX)) :].lstrip(_MARKS)
        m = _DOMAIN.match(text, at) if local else None
        if m:
            yield at - len(local), m.end(), local, m[0][1:]
        last = m.end() if m else at + 1
        at = text.find("@", last)


def _email(local: str, domain: str, key: bytes) -> str:
    """Mailbox and domain by their lower-case form; the last label stays, so the address stays valid."""
    host, dot, last = domain.rpartition(".")
    return _mixed(local.lower(), key, "mailbox") + "@" + _mixed(host.lower(), key, "domain") + dot + last


def _secret(m: re.Match, key: bytes) -> str | None:
    if not any(c.isdigit() for c in m["secret"]):
        return None
    start = m.start("secret") - m.start()
    value = m["secret"]
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        new = _hex(value, key)
        return m[0][:start] + (new.upper() if value.upper() == value else new) + m[0][start + len(value) :]
    return m[0][:start] + _mixed(value, key, "secret") + m[0][start + len(value) :]


#: Kinds in order of precedence, after addresses: pattern and what validates and replaces a match.
_KINDS = [
    ("secret", r"""(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)["']?\s*[:=]\s*["']?)(?P<secret>[A-Za-z0-9+/_=-]{16,})""", _secret),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", _ip),
    ("iso_date", r"(?<![\w-])\d{4}([-/])\d{2}\1\d{2}(?![\w-])", _iso),
    ("date", r"(?<![\w./-])\d{1,2}([./-])\d{1,2}\1\d{4}(?![\w]|[./-]\d)", _european),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _ssn),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban),
    ("card", r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?!\w|[.-]\d)", _card),
    ("phone", r"(?<![\w.-])(?:(?P<country>\+\d{1,3}[ .-]?)(?P<abroad>\(?\d{1,4}\)?(?:[ .-]?\d{2,8}){1,4})|(?P<national>\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}))(?!\w|[.-]\d)", _phone),
]
_FOUND = [(name, re.compile(pattern), change) for name, pattern, change in _KINDS]
#: What any match holds; texts without it are left as they are.
_HINT = re.compile(r"[0-9@]")


def pseudonymise(text: str, key: bytes = KEY) -> tuple[str, dict[str, int]]:
    """The text with its private values replaced, and how many there were of each kind."""
    if not _HINT.search(text):
        return text, {}
    spans = [(a, b, "email", _email(local, domain, key)) for a, b, local, domain in _emails(text)]
    for name, pattern, change in _FOUND:
        free = sorted(spans)
        more = []
        for m in pattern.finditer(text):
            i = bisect.bisect_left(free, (m.end(),))  # the first that starts at or after its end
            if i and free[i - 1][1] > m.start():
                continue
            new = change(m, key)
            if new is not None:
                more.append((m.start(), m.end(), name, new))
        spans += more
    if not spans:
        return text, {}
    out, at, kinds = [], 0, {}
    for a, b, name, new in sorted(spans):
        out += [text[at:a], new]
        at = b
        kinds[name] = kinds.get(name, 0) + 1
    return "".join([*out, text[at:]]), kinds


def pseudonyms(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """docs with text replaced, and the columns n_private and private (kind to count).

    Null texts stay null with no values; all other columns and repeated rows stay as they
    are; columns of these names are replaced; an empty table stays one.  A long text is
    read whole by one task.  Without a key, that of the session's setting serves.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY.decode()).encode()
    kept = [c for c in docs.columns if c.lower() not in ("n_private", "private")]
    where = [c.lower() for c in kept].index("text")
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(parts):
        for batch in parts:
            texts, kinds = [], []
            for t in batch.column(where).to_pylist():
                new, found = (None, {}) if t is None else pseudonymise(t, key)
                texts.append(new)
                kinds.append(list(found.items()))
            columns = list(batch.columns)
            columns[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sum(n for _, n in k) for k in kinds], pa.int64()), pa.array(kinds, pa.map_(pa.string(), pa.int64()))], [*kept, "n_private", "private"])

    return docs.select(*kept).mapInArrow(run, f"{fields}, n_private bigint, private map<string,bigint>")


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms in place of what is private, and how many there are."""
    from pyspark.sql import functions as F

    out = pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("private", F.array_join(F.array_sort(F.transform(F.map_entries("private"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ","))
