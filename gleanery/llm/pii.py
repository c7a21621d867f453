"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Base spans are what the patterns of email, ip, card and phone match, leftmost first and without overlaps within a kind, if the match passes the check of its
kind (parts up to 255; 16 to 19 digits with a Luhn sum; 8 to 15 digits); a match that fails is dropped and not tried in parts.

The method adds spans of further shapes, each with a score: that of its shape, raised where the checksum holds and where a word of its kind stands within
``NEAR`` code points, lowered where a word stands there that speaks for something else.  From ``THRESHOLD`` on, a span counts:

- ``card``: a number in a longer chain of digits that failed as a whole, alone or in the groups of a card, with a Luhn sum;
- ``short_card``: 13 to 15 digits with a Luhn sum, beside a word for cards;
- ``iban``: country, check digits and up to 30 signs with mod 97 equal to 1;
- ``ssn``: three, two and four digits in the ranges that are given out, beside a word for them;
- ``tel``: 7 to 12 digits in groups, without a plus, beside a word for telephones.

An added span that overlaps a base span, or a better added one, is left out; base spans always stay and carry a score as well.

Every pattern takes time in proportion to the text: runs are consumed whole, and an email is found from its @.  Rows are worked on by themselves and
nothing is shuffled, so no source or group of copies weighs on one task.

Special cases.  A null or empty text has no spans.  Rows with equal doc_id and text get equal results, each its own, so does a null doc_id.  An empty
table gives an empty result.  The other columns are carried along in a struct, whatever their names.  Places are code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from gleanery.llm.common import longs, with_made

KINDS = ["email", "ip", "card", "phone"]
ADDED = ["short_card", "iban", "ssn", "tel"]
ORDER = {kind: i for i, kind in enumerate([*KINDS, *ADDED])}
THRESHOLD = 0.5
NEAR = 40
RAISE, LOWER = 0.4, 0.3
#: Score of each shape; a checksum that holds adds CONFIRMED.
SHAPES = {"email": 0.9, "ip": 0.6, "card": 0.3, "phone": 0.7, "short_card": 0.1, "iban": 0.4, "ssn": 0.3, "tel": 0.2}
CONFIRMED = 0.3
#: Words that speak for a kind, and words that speak for some other number.
WORDS = {
    "email": "email e-mail mail contact write address".split(),
    "ip": "ip host server address login logged from client".split(),
    "card": "card credit debit visa mastercard amex payment pay karte kreditkarte tarjeta carte".split(),
    "phone": "phone tel telephone call mobile cell fax sms whatsapp telefon handy anruf teléfono llamar móvil téléphone appeler".split(),
    "iban": "iban bank account konto cuenta compte transfer".split(),
    "ssn": "ssn social security taxpayer".split(),
}
WORDS["short_card"], WORDS["tel"] = WORDS["card"], WORDS["phone"]
AGAINST = "order invoice isbn version serial tracking reference ref id article page figure bestellung pedido commande".split()

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# A run of digits that no address begins with is consumed whole.
ADDRESS = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
DOTTED = re.compile(r"\.[0-9]++\.[0-9]++\.[0-9]")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
GROUP = re.compile(r"[0-9]+")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
TEL = re.compile(r"(?<![0-9+().-])\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,5}){1,4}+(?![0-9.-]*[0-9])")
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
#: Digits of the groups in which cards are written.
CARD_GROUPS = {(4, 4, 4, 4), (4, 4, 4, 4, 3)}

Span = tuple[str, int, int, float, bool]  # kind, start, end, score, base


def digits_of(text: str) -> str:
    return "".join(GROUP.findall(text))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return not (total + sum(map(int, "".join(str(2 * int(d)) for d in digits[-2::-2])))) % 10


def mod97(iban: str) -> bool:
    rest = 0
    for sign in iban[4:] + iban[:4]:
        value = int(sign, 36)
        rest = (rest * (100 if value > 9 else 10) + value) % 97
    return rest == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is the run before an @, from the last email on."""
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        match = DOMAIN.match(text, at)
        if match:
            low = max(end, text.rfind("@", end, at) + 1)
            local = at - low - len(text[low:at].rstrip(LOCAL))
            if local:
                end = match.end()
                yield at - local, end
                at = end
                continue
        at += 1


def addresses(text: str) -> Iterator[tuple[int, int]]:
    if DOTTED.search(text):
        for match in ADDRESS.finditer(text):
            if match[1] and all(len(p) < 3 or len(p) == 3 and int(p) < 256 for p in (p.lstrip("0") for p in match[0].split("."))):
                yield match.span()


def base_spans(text: str, chains: list[re.Match]) -> list[tuple[str, int, int]]:
    found = [("email", *s) for s in emails(text)] if "@" in text else []
    found += [("ip", *s) for s in addresses(text)]
    for chain in chains:
        if 16 <= chain.end() - chain.start() < 38 and 16 <= len(digits := digits_of(chain[0])) <= 19 and luhn(digits):
            found.append(("card", *chain.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return found


def context(text: str, start: int, end: int) -> set[str]:
    near = text[max(0, start - NEAR):start] + " \n " + text[end:end + NEAR]
    return set(WORD.findall(near.lower()))


def scored(text: str, kind: str, start: int, end: int, confirmed: bool) -> float:
    near = context(text, start, end)
    score = SHAPES[kind] + CONFIRMED * confirmed
    score += RAISE if not near.isdisjoint(WORDS[kind]) else -LOWER if not near.isdisjoint(AGAINST) else 0
    return round(min(max(score, 0.0), 1.0), 3)


def numbers_in(chain: re.Match) -> Iterator[tuple[str, int, int]]:
    """Numbers of 13 to 19 digits within a chain, alone or in the groups of a card."""
    groups = [(m.start() + chain.start(), m[0]) for m in GROUP.finditer(chain[0])]
    for i, (start, digits) in enumerate(groups):
        if 13 <= len(digits) <= 19:
            yield digits, start, start + len(digits)
        for n in (5, 4):
            some = groups[i:i + n]
            if tuple(len(d) for _, d in some) in CARD_GROUPS:
                yield "".join(d for _, d in some), start, some[-1][0] + len(some[-1][1])


def proposed(text: str, chains: list[re.Match]) -> Iterator[tuple[str, int, int, bool]]:
    """kind, start, end, confirmed of the added shapes."""
    for chain in chains:
        if chain.end() - chain.start() >= 13:
            for digits, start, end in numbers_in(chain):
                if digits[0] in "3456" and luhn(digits):
                    yield "card" if len(digits) > 15 else "short_card", start, end, True
    for match in IBAN.finditer(text):
        if 15 <= len(iban := match[0].replace(" ", "")) <= 34 and mod97(iban):
            yield "iban", *match.span(), True
    if chains:
        for match in SSN.finditer(text):
            area, group, serial = match[0].split("-")
            if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000":
                yield "ssn", *match.span(), False
        for match in TEL.finditer(text):
            if 7 <= len(digits_of(match[0])) <= 12:
                yield "tel", *match.span(), False


def spans_of(text: str) -> list[Span]:
    """All spans, by kind and place."""
    chains = list(CHAIN.finditer(text))
    found = [(*s, scored(text, *s, s[0] == "card"), True) for s in base_spans(text, chains)]
    added = [(k, a, b, s) for k, a, b, sure in proposed(text, chains) if (s := scored(text, k, a, b, sure)) >= THRESHOLD]
    if added:
        taken = sorted((a, b) for _, a, b, _, _ in found)
        for kind, start, end, score in sorted(added, key=lambda s: (-s[3], s[1], ORDER[s[0]], s[2])):
            if all(end <= a or b <= start for a, b in taken):
                taken.append((start, end))
                found.append((kind, start, end, score, False))
    return sorted(found, key=lambda s: (ORDER[s[0]], s[1]))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                     T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType())])
ARROW = {"kind": pa.string(), "start": pa.int64(), "end": pa.int64(), "score": pa.float64(), "base": pa.bool_()}


def found_in(texts: list[bytes | None], more: Callable[[str, list[Span]], object] | None = None) -> tuple[pa.Array, list]:
    sizes, rows, other = [0], [], []
    for raw in texts:
        text = raw.decode() if raw else ""
        own = spans_of(text)
        rows += own
        sizes.append(len(rows))
        if more:
            other.append(None if raw is None else more(text, own))
    columns = list(zip(*rows)) or [[]] * len(ARROW)
    spans = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.values())], list(ARROW))
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), spans), other


def find(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Struct columns ``row`` (the kept columns, all by default) and ``made`` (spans: kind, start, end, score, base)."""
    return with_made(docs, docs.columns if keep is None else keep, "text", T.StructType([T.StructField("spans", T.ArrayType(SPAN))]),
                     lambda _, texts: {"spans": found_in(texts)[0]})


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with the kind in the place of each span; of overlapping ones, the first."""
    parts, last = [], 0
    for kind, start, end, _, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= last:
            parts += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, end)
    return "".join([*parts, text[last:]])


def mask(docs: DataFrame) -> DataFrame:
    """The documents, in their columns, with kinds in the place of spans."""
    made = with_made(docs, docs.columns, "text", T.StructType([T.StructField("text", T.StringType())]),
                     lambda _, texts: {"text": pa.array(found_in(texts, masked)[1], pa.string())})
    return made.select(*[(F.col("made.text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, comma-joined), scores.

    ``scores`` are those of ``spans``, in their order.
    """
    schema = T.StructType([*[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base", T.StringType()),
                           T.StructField("spans", T.StringType()), T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def make(_, texts):
        rows = [spans_of(raw.decode()) if raw else [] for raw in texts]
        joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b, _, _ in spans)
        counts = {f"n_{k}": longs([sum(s[0] == k and s[4] for s in own) for own in rows]) for k in KINDS}
        return {**counts, "base": pa.array([joined(s for s in own if s[4]) for own in rows], pa.string()),
                "spans": pa.array([joined(own) for own in rows], pa.string()),
                "scores": pa.array([[s[3] for s in own] for own in rows], pa.list_(pa.float64()))}

    return with_made(docs, ["doc_id"], "text", schema, make).select(
        "row.doc_id", *[f"made.n_{k}" for k in KINDS], F.sha2("made.base", 256).alias("base_sha256"), "made.spans", "made.scores")
