"""Personal data by anchors: Aho-Corasick finds where to look, local parsers find the borders."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Kinds in the order in which spans with the same start are listed: the base
# kinds first, then those that the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "address", "secret")
KINDS = BASE + ADDED

DIGITS = frozenset(string.digits)
ALNUM = frozenset(string.ascii_letters + string.digits)
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
SECRET = ALNUM | frozenset("_-+/=.")
# Words that announce an account number or a secret.
ACCOUNT_CUES = ("iban", "account", "acct", "passport", "ssn", "konto", "compte", "cuenta")
SECRET_CUES = ("token", "secret", "password", "api_key", "apikey", "api-key")


def run_end(text: str, at: int, allowed: frozenset) -> int:
    end = len(text)
    while at < end and text[at] in allowed:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def parse_email(text: str, at: int, floor: int):
    """The address around the at-sign at ``at``, not reaching before ``floor``."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = run_end(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == ".":
        more = run_end(text, end + 1, LABEL)
        if more == end + 1:
            break
        end, labels = more, labels + 1
    return (start, end) if labels else None


def parse_dotted(text: str, first: int) -> tuple[list[tuple[int, int]], int]:
    """(valid IPv4 spans, end) of the chain of dotted digit groups that starts at ``first``."""
    groups, at = [], first
    while True:
        end = run_end(text, at, DIGITS)
        groups.append((at, end))
        if end + 1 >= len(text) or text[end] != "." or text[end + 1] not in DIGITS:
            break
        at = end + 1
    spans = []
    for k in range(0, len(groups) - 3, 4):
        four = groups[k : k + 4]
        if all(len(p) <= 3 and int(p or "0") <= 255
               for p in (text[a:b].lstrip("0") for a, b in four)):
            spans.append((four[0][0], four[3][1]))
    return spans, groups[-1][1]


def parse_card(text: str, first: int):
    """(span or None, end) of the digits with single blanks or hyphens that start at ``first``."""
    at, digits = first + 1, [text[first]]
    while at < len(text):
        if text[at] in DIGITS:
            step = 1
        elif text[at] in " -" and at + 1 < len(text) and text[at + 1] in DIGITS:
            step = 2
        else:
            break
        at += step
        digits.append(text[at - 1])
    good = 12 <= len(digits) <= 19 and luhn("".join(digits))
    return ((first, at) if good else None), at


def parse_phone(text: str, plus: int):
    """(span or None, end) of the number behind the plus sign at ``plus``; end is where search goes on."""
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None, plus + 1
    end = run_end(text, plus + 2, PHONE)
    while end > plus + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end < plus + 4:
        return None, plus + 1
    digits = sum(c in DIGITS for c in text[plus + 1 : end])
    return ((plus, end) if 9 <= digits <= 15 else None), end


# Registered lengths of IBANs.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def parse_iban(text: str, at: int):
    """An IBAN at ``at`` (blanks between groups allowed), by its check digits.

    It has 15 to 34 characters, ends where a group ends and passes the check:
    the one of the country's registered length, or else the longest. Words that
    follow it are not part of it.
    """
    head = text[at : at + 4]
    if len(head) < 4 or not (head[:2].isascii() and head[:2].isupper() and head[2:].isascii() and head[2:].isdigit()):
        return None
    end, kept, ends = at, [], []
    while end < len(text) and len(kept) < 34:
        if text[end] in DIGITS or text[end] in string.ascii_uppercase:
            kept.append(text[end])
            end += 1
        elif text[end] == " " and end + 1 < len(text) and (
            text[end + 1] in DIGITS or text[end + 1] in string.ascii_uppercase
        ):
            ends.append((len(kept), end))
            end += 1
        else:
            break
    ends.append((len(kept), end))
    ends = sorted((e for e in ends if e[0] >= 15), key=lambda e: (e[0] == IBAN_LENGTHS.get(head[:2]), e[0]))
    for n, end in reversed(ends):
        number = "".join(kept[4:n] + kept[:4])
        if int("".join(str(int(c, 36)) for c in number)) % 97 == 1:
            return at, end
    return None


def after_cue(text: str, at: int) -> int:
    """Where the value behind a cue begins: past one optional '=', ':' or '#' and blanks and a quote."""
    at = run_end(text, at, frozenset(" \t"))
    if at < len(text) and text[at] in "=:#":
        at = run_end(text, at + 1, frozenset(" \t"))
    if at < len(text) and text[at] in "\"'":
        at += 1
    return at


def parse_account(text: str, end: int):
    """A value behind an account cue: an IBAN, or 6 to 18 digits with single blanks or hyphens."""
    at = after_cue(text, end)
    iban = parse_iban(text, at)
    if iban or at >= len(text) or text[at] not in DIGITS:
        return iban
    _, stop = parse_card(text, at)
    digits = sum(c in DIGITS for c in text[at:stop])
    bare = stop == len(text) or text[stop] not in ALNUM
    return (at, stop) if 6 <= digits <= 18 and bare else None


def parse_secret(text: str, end: int):
    """A quoted or assigned value of 16 characters or more with letters and digits behind a secret cue."""
    at = after_cue(text, end)
    if at == end or not any(c in "=:" for c in text[end:at]):
        return None
    stop = run_end(text, at, SECRET)
    value = text[at:stop].rstrip(".")
    mixed = any(c in DIGITS for c in value) and any(c.isalpha() for c in value)
    return (at, at + len(value)) if len(value) >= 16 and mixed else None


def parse_address(text: str, at: int):
    """``scheme://user:password@host``: the part behind the scheme up to the end of the host."""
    end = at + 3
    while end < len(text) and not text[end].isspace() and text[end] not in "/?#\"'<>":
        end += 1
    user, mark, host = text[at + 3 : end].rpartition("@")
    return (at + 3, end) if mark and user and run_end(host, 0, LABEL) > 0 else None


def automaton():
    """Anchors of all kinds; a value says which parser to call."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for mark in "@+":
        found.add_word(mark, (mark, 1))
    found.add_word("://", ("url", 3))
    for digit in string.digits:
        found.add_word(digit, ("digit", 1))
    for what, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in (cue, cue.upper(), cue.capitalize()):
                found.add_word(form, (what, len(form)))
    found.make_automaton()
    return found


def find_spans(text: str, anchors) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind.

    Base kinds are found left to right without overlaps within a kind; a match
    that fails its check is passed over whole.
    """
    spans: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)

    def add(kind: str, span):
        if span and (kind in BASE or span[0] >= done[kind]):
            spans.append((kind, *span))
            done[kind] = span[1]

    ip_at = card_at = phone_at = 0
    for last, (what, length) in anchors.iter(text):
        start = last - length + 1
        if what == "digit":
            if start >= ip_at:
                found, ip_at = parse_dotted(text, start)
                for span in found:
                    add("ip", span)
            if start >= card_at:
                span, card_at = parse_card(text, start)
                add("card", span)
        elif what == "@":
            add("email", parse_email(text, start, done["email"]))
        elif what == "+":
            if start >= phone_at:
                span, phone_at = parse_phone(text, start)
                add("phone", span)
        elif what == "url":
            add("address", parse_address(text, start))
        elif start == 0 or text[start - 1] not in ALNUM:
            add(what, (parse_account if what == "account" else parse_secret)(text, last + 1))
    rank = {kind: k for k, kind in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and found (array of kind, start, end) of every document.

    Whole texts are read; null counts as empty and has no spans. Offsets are
    code points, the end exclusive. Repeated rows are reported each, an empty
    table gives no rows, other columns are ignored. Row-local, no shuffle.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            found = [
                [{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t or "", anchors)]
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, SPAN_TYPE)], ["doc_id", "found"]
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        find, "doc_id long, found array<struct<kind:string,start:long,end:long>>"
    )


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlaps merge into the first."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans from :func:`personal_data`."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[(s["kind"], s["start"], s["end"]) for s in spans]
                    for spans in batch.column("found").to_pylist()]
            counts = [pa.array([sum(k == kind for k, _, _ in r) for r in rows], pa.int64())
                      for kind in BASE]
            base = [hashlib.sha256(joined([s for s in r if s[0] in BASE]).encode()).hexdigest()
                    for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(base, pa.string()),
                 pa.array([joined(r) for r in rows], pa.string())],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    return found.mapInArrow(
        finish,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
        "base_sha256 string, spans string",
    )
