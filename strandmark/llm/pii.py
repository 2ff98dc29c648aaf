"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, scheme separators, plus signs, digits and
identifier cues of accounts and secrets. A deterministic parser expands each anchor in place, to the left and to the right, and
validates what it finds. Nothing is shuffled; rows are read as a stream.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions

#: Base kinds in the order that ties of start follow, then those that the method adds.
KINDS = ("email", "ip", "card", "phone", "account", "link", "secret")
#: Cues of account numbers and of secrets; fixed values.
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "passport", "ssn")
SECRETS = ("token", "password", "passwd", "secret", "api_key", "apikey", "api-key", "access_key")
#: Characters of an international bank account number by country, as published in its registry; fixed values.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ACCOUNT = re.compile(r"(?:[\x20](?:no|nr|number)\b\.?)?[\x20]?[:#=]?[\x20]?([A-Z]{0,2}[0-9][A-Z0-9]*(?:[\x20-][A-Z0-9]+)*)")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Za-z0-9])+")
SECRET = re.compile(r"[\"']?[\x20]{0,2}[:=][\x20]{0,2}[\"']?([A-Za-z0-9_./+=-]{16,})")
USER = re.compile(r"://[^\x00-\x20/@<>\"]+@[^\x00-\x20<>\"]+")
_AUTOMATON = None


def automaton() -> ahocorasick.Automaton:
    global _AUTOMATON
    if _AUTOMATON is None:
        a = ahocorasick.Automaton()
        for d in "0123456789":
            a.add_word(d, ("digit", 1))
        a.add_word("@", ("at", 1))
        a.add_word("+", ("plus", 1))
        a.add_word("://", ("scheme", 3))
        for kind, cues in (("cue", CUES), ("secret", SECRETS)):
            for form in {f for cue in cues for f in (cue, cue.upper(), cue.capitalize())}:
                a.add_word(form, (kind, len(form)))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def iban_end(text: str, start: int) -> int | None:
    """Where the bank account number of the place ends: as long as its country's are, with a remainder of 1; None if it isn't one."""
    m = IBAN.match(text, start)
    length = IBAN_LENGTHS.get(m[0][:2]) if m else None
    if length is None:
        return None
    end, own = start, ""
    while end < m.end() and len(own) < length:
        if text[end].isalnum():
            own += text[end]
        end += 1
    if len(own) < length or (end < len(text) and text[end].isascii() and text[end].isalnum()):
        return None
    digits = "".join(str(int(c, 36)) for c in own[4:] + own[:4])
    return end if int(digits) % 97 == 1 else None


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, number of its kind, end) of every span, in order; of a kind, spans don't overlap."""
    out = []
    done = [0] * len(KINDS)  # where the last match of each kind ended, valid or not
    for last, (kind, size) in automaton().iter(text):
        at = last - size + 1
        if kind == "digit":
            if at and "0" <= text[at - 1] <= "9":
                continue  # only the first digit of a run can start a match
            if at >= done[1] and (m := IP.match(text, at)):
                done[1] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    out.append((at, 1, m.end()))
            if at >= done[2] and (m := CARD.match(text, at)):
                done[2] = m.end()
                if 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                    out.append((at, 2, m.end()))
        elif kind == "at":
            if m := DOMAIN.match(text, at):
                start = at
                while start > done[0] and text[start - 1] in LOCAL:
                    start -= 1
                if start < at:
                    done[0] = m.end()
                    out.append((start, 0, m.end()))
        elif kind == "plus":
            if at >= done[3] and (m := PHONE.match(text, at)):
                done[3] = m.end()
                if 9 <= len(digits_of(m[0])) <= 15:
                    out.append((at, 3, m.end()))
        elif kind == "scheme":
            if m := USER.match(text, at):
                start = at
                while start > done[5] and text[start - 1] in SCHEME:
                    start -= 1
                if start < at:
                    done[5] = m.end()
                    out.append((start, 5, m.end()))
        elif kind == "secret":
            if at >= done[6] and (m := SECRET.match(text, last + 1)):
                done[6] = m.end()
                if any("0" <= c <= "9" for c in m[1]):
                    out.append((m.start(1), 6, m.end(1)))
        elif at >= done[4] and not (at and text[at - 1].isalnum()) and (m := ACCOUNT.match(text, last + 1)):
            done[4] = m.end()
            if IBAN.match(text, m.start(1)) and m[1][:2] in IBAN_LENGTHS:
                if end := iban_end(text, m.start(1)):
                    out.append((m.start(1), 4, end))
                    done[4] = max(done[4], end)
            elif 6 <= len(digits_of(m[1])) <= 30:
                out.append((m.start(1), 4, m.end(1)))
    out.sort()
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans) -> str:
    """The text with a mark of its kind in the place of each span; spans that overlap become one, marked as the first."""
    out, at, i = [], 0, 0
    while i < len(spans):
        a, k, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][2])
            i += 1
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def _rows(batches):
    for batch in portions(batches):
        cols: list[list] = [[] for _ in FOUND]
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            spans = find(text)
            n = [0] * len(KINDS)
            for _, k, _ in spans:
                n[k] += 1
            base = joined(s for s in spans if s[1] < 4)
            for c, v in zip(cols, [doc_id, *n, hashlib.sha256(base.encode()).hexdigest(), joined(spans)], strict=True):
                c.append(v)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, FOUND, strict=True)], schema=FOUND)


def personal_data(docs: DataFrame) -> DataFrame:
    """Personal data of every row of docs(doc_id, text): counts by kind, the digest of the base spans, all spans.

    A null or empty text has no spans, and the digest of the empty string. Repeated rows are reported each;
    a null doc_id stays null; other columns are not read; an empty table gives no rows.
    """
    fields = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in FOUND)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_rows, fields)


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of its text column replaced by the mark of its kind; other columns, null and empty texts and repeated rows stay."""
    at = docs.columns.index(text)

    def rows(batches):
        for batch in portions(batches):
            new = [None if t is None else masked(t, find(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(rows, docs.schema)
