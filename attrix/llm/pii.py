"""Personal data by anchor expansion.

One Aho-Corasick pass finds the anchors: at-signs, plus signs, digits, ``://``
and cue words such as ``password``.  From an anchor a parser of its kind goes
left and right to the bounds of the address, number or account and validates
it.  A parser looks at its own surroundings only, and never goes back before
the end of the last match of its kind.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm import flat
from attrix.llm.shared import pick, ship_code

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds of the method's own: user and password in a URL, values after a cue, IBANs and social security numbers after theirs.
OWN_KINDS = ("login", "secret", "iban", "ssn")
SECRET_CUES = ("password", "passwd", "token", "secret", "api_key", "apikey")
ID_CUES = {"iban": "iban", "ssn": "ssn"}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DIGITS = re.compile(r"[0-9]+")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
NUMBER = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/@:\"'<>]+:[^\s/@\"'<>]+(?=@[A-Za-z0-9.-])")
SECRET = re.compile(r"[\x20\t]*[:=][\x20\t]*[\"']?([A-Za-z0-9_./+=-]{8,})")
IBAN = re.compile(r"[\x20\t:=#]{1,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){10,30})(?![A-Za-z0-9])")
SSN = re.compile(r"[\x20\t:=#]{1,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


@functools.cache
def anchors():
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    for sign in ("@", "+", "://"):
        a.add_word(sign, (sign, len(sign)))
    for cue in (*SECRET_CUES, *ID_CUES):
        for form in (cue, cue.upper(), cue.capitalize()):
            a.add_word(form, (ID_CUES.get(cue, "secret"), len(form)))
    a.make_automaton()
    return a


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, ordered by kind as listed and then by start."""
    out: dict[str, list[tuple[str, int, int]]] = {k: [] for k in (*BASE_KINDS, *OWN_KINDS)}
    past = dict.fromkeys(out, 0)  # by kind, the end of what is settled

    def add(kind: str, start: int, end: int) -> None:
        out[kind].append((kind, start, end))

    for last, (what, size) in anchors().iter(text):
        at = last - size + 1
        if what == "digit":
            if at >= past["ip"]:
                m = ADDRESS.match(text, at)
                if m and all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.groups()):
                    add("ip", at, m.end())
                past["ip"] = m.end() if m else DIGITS.match(text, at).end()
            if at >= past["card"]:
                m = CHAIN.match(text, at)
                past["card"] = m.end() if m else at + 1
                if m:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        add("card", at, m.end())
        elif what == "@":
            start = at
            while start > past["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                add("email", start, m.end())
                past["email"] = m.end()
        elif what == "+":
            if at >= past["phone"] and (m := NUMBER.match(text, at)):
                past["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    add("phone", at, m.end())
        elif what == "://":
            if m := LOGIN.match(text, last + 1):
                add("login", m.start(), m.end())
        elif what == "secret":
            # a value that begins within the last one would end with it, except after its last sign
            if last + 2 >= past["secret"] and (m := SECRET.match(text, last + 1)) and m.start(1) >= past["secret"]:
                past["secret"] = m.end()
                if any(c.isdigit() for c in m[1]):
                    add("secret", *m.span(1))
        elif (m := (IBAN if what == "iban" else SSN).match(text, last + 1)) and m.start(1) >= past[what] and (what != "iban" or iban_valid(m[1])):
            add(what, *m.span(1))
            past[what] = m.end()
    return [s for spans in out.values() for s in spans]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and spans, an array of (kind, start, end).

    Offsets are code points, ends exclusive; spans come by kind as listed,
    then by start.  Null and empty texts have no spans.  Ids are passed
    through (null, repeated); an empty table gives an empty result; other
    columns are ignored.
    """
    ship_code(docs.sparkSession)
    base = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("string").alias("text"))
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.byte_slices(batch):
                spans = [find_spans(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[dict(zip(("kind", "start", "end"), s)) for s in row] for row in spans], pa.list_(item))], ["doc_id", "spans"])

    kind = dict(base.dtypes)["doc_id"]
    return base.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans as text."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(of(*BASE_KINDS)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
