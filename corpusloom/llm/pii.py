"""Personal data in texts, found by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus-digit, digit-dot-digit, neighbouring digits, URL schemes
and identifier cues. A deterministic parser for the anchor's kind then grows the match around it and validates it.

Null text counts as empty and has no spans. Rows are independent: repeated rows and repeated or null ids give
repeated results, an empty table an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import read, slices

BASE_KINDS = ("email", "ip", "card", "phone")
#: What the anchors of schemes and identifier cues add.
EXTRA_KINDS = ("url", "account")
KINDS = BASE_KINDS + EXTRA_KINDS

SCHEMES = ("http://", "https://", "ftp://", "www.")
CUES = ("iban", "account", "acct", "passport", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"(?:(?:https?|ftp)://|www\.)[^\s<>\"'`\\|]++")
_ACCOUNT = re.compile(r"[ \t]{0,4}(?:(?:no|nr|number|id)\b\.?)?[ \t]{0,4}[:#=]?[ \t]{0,4}([A-Z]{0,3}[0-9](?:[ -]?[A-Z0-9])*+)")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


@functools.cache
def _anchors():
    import ahocorasick

    anchors = ahocorasick.Automaton()
    digits = "0123456789"
    add = lambda word, kind: anchors.add_word(word, (kind, len(word)))
    add("@", "email")
    for a in digits:
        add(f"+{a}", "phone")
        for b in digits:
            add(f"{a}.{b}", "ip")
            for gap in ("", " ", "-"):
                add(f"{a}{gap}{b}", "card")
    for word in SCHEMES:
        add(word, "url")
    for word in CUES:
        for form in {word, word.upper(), word.capitalize()}:
            add(form, "account")
    anchors.make_automaton()
    return anchors


def _email(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    found = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, found.end(), True) if found else None


def _ip(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    while at > floor and "0" <= text[at - 1] <= "9":
        at -= 1
    found = _IP.match(text, at)
    if not found:
        return None
    return at, found.end(), all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in found.groups())


def _card(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    found = _CARD.match(text, at)
    digits = found[0].replace(" ", "").replace("-", "")
    return at, found.end(), 16 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    found = _PHONE.match(text, at)
    if not found:
        return None
    return at, found.end(), 8 <= sum("0" <= c <= "9" for c in found[0]) <= 15


def _url(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    found = _URL.match(text, at)
    if not found or (at and text[at - 1].isalnum()):
        return None
    end = at + len(found[0].rstrip(".,;:!?)]}"))
    host = re.sub(r"^[a-z]+://", "", text[at:end]).split("/")[0]
    return at, max(end, at + 1), "." in host.strip(".")


def _account(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """at: where the cue ends."""
    found = _ACCOUNT.match(text, at)
    if not found:
        return None
    symbols = found[1].replace(" ", "").replace("-", "")
    return found.start(1), found.end(1), 6 <= len(symbols) <= 34 and sum(c.isdigit() for c in symbols) >= 4


_PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "url": _url, "account": _account}


def find_spans(text: str | None) -> dict[str, list[Span]]:
    """Spans by kind, in order and without overlap within a kind; code points, end exclusive."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    ends = dict.fromkeys(KINDS, 0)
    for last, (kind, width) in _anchors().iter(text) if text else ():
        at = last + 1 - width
        floor = ends[kind]
        if at < floor:
            continue
        if kind == "account":
            if (at and text[at - 1].isalnum()) or text[last + 1 : last + 2].isalpha():
                continue
            at = last + 1
        if found := _PARSERS[kind](text, at, floor):
            start, end, valid = found
            ends[kind] = end
            if valid:
                out[kind].append((kind, start, end))
    return out


def pii_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and spans array<struct<kind, start, end, value>>, by kind as in KINDS, then start."""
    schema = df.select(F.col(f"`{id_col}`").alias("id")).schema["id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [[{"kind": k, "start": s, "end": e, "value": text[s:e]} for found in find_spans(text).values() for k, s, e in found] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["id", "spans"])

    found = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(scan, f"id {schema}, spans array<struct<kind string, start bigint, end bigint, value string>>")
    return found.select(F.col("id").alias(id_col), "spans")


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii_spans(read(spark, sf_dir, "documents"))
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
