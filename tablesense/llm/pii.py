"""Personal data by anchor expansion: an automaton finds cues, local parsers find and check the bounds."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("email", "ip", "card", "phone", "address", "account")
#: Fixed cues: schemes that an address follows, and names that an account number follows.
SCHEMES = ("://", "mailto:", "tel:", "sip:", "xmpp:")
ACCOUNTS = ("iban", "account number", "account no", "acct", "ssn", "social security", "passport")

DIGITS = frozenset("0123456789")
ALNUM = DIGITS | frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
ADDRESS = ALNUM | frozenset("-._~%!$&'()*+,;=:@")
#: Between a cue and its number; and within a number.
GAP, JOINTS = frozenset(" :#.="), frozenset(" -")

Span = tuple[int, int]


def _run(text: str, at: int, chars: frozenset) -> int:
    """First place from ``at`` on that holds no character of ``chars``."""
    end = len(text)
    while at < end and text[at] in chars:
        at += 1
    return at


def email_at(text: str, at: int, floor: int) -> Span | None:
    """The address around the at-sign at ``at`` that starts no earlier than ``floor``."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == ".":
        after = _run(text, end + 1, LABEL)
        if after == end + 1:
            break
        end, dots = after, dots + 1
    return (start, end) if dots else None


def ip_at(text: str, at: int) -> tuple[Span | None, int]:
    """Four numbers joined by dots, the first from ``at`` on, and where to look on."""
    ends, end = [], at
    while len(ends) < 4:
        after = _run(text, end, DIGITS)
        if after == end:
            return None, end  # what follows the last dot is no number
        ends.append(after)
        if len(ends) < 4:
            if after == len(text) or text[after] != ".":
                return None, after
            end = after + 1
    return (at, ends[3]), ends[3]


def is_ip(span: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in span.split("."))


def card_at(text: str, at: int) -> int:
    """End of the longest run of digits with at most one blank or hyphen between two of them."""
    end = _run(text, at, DIGITS)
    while end + 1 < len(text) and text[end] in JOINTS and text[end + 1] in DIGITS:
        end = _run(text, end + 1, DIGITS)
    return end


def is_card(span: str) -> bool:
    digits = [ord(c) - 48 for c in span if c in DIGITS]
    if not 14 <= len(digits) <= 19:
        return False
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def phone_at(text: str, at: int) -> int | None:
    """End of the number that the plus sign at ``at`` opens."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = _run(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return end if end > at + 3 else None


def is_phone(span: str) -> bool:
    return 10 <= sum(c in DIGITS for c in span) <= 15


def address_at(text: str, at: int, cue: str) -> Span | None:
    """A scheme's personal address: one with user and host, or a number or handle after its scheme.

    A plain link to a site is nobody's address and gives no span.
    """
    after = at + len(cue)
    end = _run(text, after, ADDRESS)
    while end > after and text[end - 1] in ".,;:!'()":
        end -= 1
    body = text[after:end]
    start = at
    if cue == "://":
        while start and text[start - 1] in ALNUM | frozenset("+.-"):
            start -= 1
        user, _, host = body.rpartition("@")
        return (start, end) if start < at and user and host.strip(".:") else None
    if start and text[start - 1] in ALNUM:
        return None
    if cue == "tel:":
        return (start, end) if 7 <= sum(c in DIGITS for c in body) <= 15 else None
    user, _, host = body.partition("@")
    return (start, end) if user and "." in host.strip(".") else None


def is_iban(number: str) -> bool:
    """ISO 13616: two letters, two digits, up to 30 letters or digits, remainder 1 modulo 97."""
    if not (15 <= len(number) <= 34 and number[:2].isalpha() and number[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


def account_at(text: str, at: int, cue: str) -> Span | None:
    """The number that follows the cue: an IBAN that checks, or one of 6 to 20 letters and digits with 6 digits."""
    if at and text[at - 1] in ALNUM:
        return None
    start = _run(text, at + len(cue), GAP)
    if start == at + len(cue) or start >= len(text):
        return None
    if cue == "iban":
        end, number = start, ""
        while end < len(text) and len(number) < 34 and (text[end] in ALNUM or text[end] == " "):
            number += text[end].strip()
            end += 1
            if (end == len(text) or text[end] not in ALNUM) and is_iban(number.upper()):
                return start, end
        return None
    end = start
    while end < len(text) and (text[end] in ALNUM or text[end] == "-"):
        end += 1
    while end > start and text[end - 1] == "-":
        end -= 1
    body = text[start:end].replace("-", "")
    return (start, end) if 6 <= len(body) <= 20 and sum(c in DIGITS for c in body) >= 6 else None


@functools.lru_cache(maxsize=1)
def automaton():
    """All cues, in lower case: at-sign, plus sign, digits, schemes and account names."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for cue in ("@", "+", *sorted(DIGITS), *SCHEMES, *ACCOUNTS):
        found.add_word(cue, cue)
    found.make_automaton()
    return found


def lower_cues(text: str) -> str:
    """A-Z in lower case; the same places hold the same characters otherwise."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal data in ``text``, by start, then kind as listed.

    The four base kinds are the leftmost matches, not overlapping within a kind, of their patterns
    (email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, ip four dotted numbers, card digits with
    single blanks or hyphens, phone a plus sign and digits), kept if valid.  Schemes and account cues
    add spans of kinds of their own and change none of these.
    """
    spans: list[tuple[int, int, str]] = []
    mail = dotted = digits = number = 0  # where each kind looks on: the end of its last match
    for last, cue in automaton().iter(lower_cues(text)):
        at = last - len(cue) + 1
        if cue in DIGITS:
            if at >= digits:
                digits = card_at(text, at)
                if is_card(text[at:digits]):
                    spans.append((at, digits, "card"))
            if at >= dotted:
                span, dotted = ip_at(text, at)
                if span and is_ip(text[span[0]:span[1]]):
                    spans.append((*span, "ip"))
        elif cue == "@":
            if span := email_at(text, at, mail):
                mail = span[1]
                spans.append((*span, "email"))
        elif cue == "+":
            if at >= number and (end := phone_at(text, at)):
                number = end
                if is_phone(text[at:end]):
                    spans.append((at, end, "phone"))
        elif cue in SCHEMES:
            if span := address_at(text, at, cue):
                spans.append((*span, "address"))
        elif span := account_at(text, at, cue):
            spans.append((*span, "account"))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return spans


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans) of every row; ``spans`` lists (kind, start, end) in code points, end exclusive.

    Whole texts are read in one pass of the automaton, whose cues are fixed; nothing is shuffled, and
    a worker holds one batch of rows.

    Defined cases: null and empty texts have no spans; null ids are kept; repeated rows each get
    their spans; a text of any length is one pass; an empty table gives no rows; other columns
    are ignored.  Overlapping spans of different kinds are all listed.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for a, b, k in find_spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=[id_col, "spans"])

    slim = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return slim.mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of ``text_col`` replaced by its kind in angle brackets; overlapping spans are one, of the first's kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            out = []
            for text in batch.column(at).to_pylist():
                parts, end = [], 0
                for a, b, k in find_spans(text) if text else []:
                    if a >= end:
                        parts += [text[end:a], f"<{k}>"]
                    end = max(end, b)
                out.append(text if text is None else "".join([*parts, text[end:]]))
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
