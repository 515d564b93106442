"""Personal data: detectors over the text, and over a deobfuscated form of it whose spans are mapped back.

The base detectors run on the text as it is. For the rest, transducers rewrite the text and keep, for each character they
put out, the stretch of source characters it stands for: homoglyphs and full-width forms become ASCII, runs of spelled
digits become digits, and "at" and "dot" in brackets, or between words that form an address, become @ and a dot. The same
detectors then run on what they put out, and spans are mapped back to source characters. A span of this kind is added where
it overlaps no base span of its kind, or holds it and more (an address whose first letters are disguised); base spans stay as they are.

Defined cases: a null or empty text has no spans; offsets are code points, ends exclusive; rows are judged one by one, so
repeated rows get equal results; detectors take time in proportion to the text, which is searched whole; columns other than doc_id
and text aren't read by scanned() and pass through redacted(), whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that fails at the start of a run of digits fails within it
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int]


def _emails(text: str) -> list[Span]:
    """Leftmost matches: from each @ to the left as far as the run of local characters goes, and the domain to the right."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        if domain:
            start = at
            while start > free and _LOCAL_END.match(text, start - 1):
                start -= 1
            if start < at:
                out.append((start, domain.end()))
                free = domain.end()
        at = text.find("@", max(at + 1, free))
    return out


def _ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def _phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15] if "+" in text else []


def detected(text: str) -> dict[str, list[Span]]:
    return {"email": _emails(text), "ip": _ips(text), "card": _cards(text), "phone": _phones(text)}


# --- transducers: each rewrites some stretches of a text, and says which

#: Letters that look like ASCII ones, and punctuation alike (fixed values).
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅαοντρικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ․。．＠﹫＋‐‑–−", "aeopcyxijsdhqwABEKMHOPCTYXIJSaovtpikABEZHIKMNOPTYX...@@+----", strict=True))
HOMOGLYPHS |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
for _zero in (0x0660, 0x06F0, 0x0966):
    HOMOGLYPHS |= {chr(_zero + i): str(i) for i in range(10)}
#: Spelled digits in the four languages of the corpus, and words that stand for signs (fixed values).
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_HOMOGLYPH = re.compile("[" + "".join(map(re.escape, HOMOGLYPHS)) + "]")
_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
_GAP = r"[\x20,.-]{1,2}"
_SPELLED = re.compile(rf"(?<!\w)(?:(?:plus{_GAP})?(?:{_WORD}))(?:{_GAP}(?:{_WORD}|[0-9]+|dot|point))*(?:{_GAP}(?:{_WORD}|[0-9]+))(?!\w)", re.IGNORECASE)
_TOKEN = re.compile(rf"(?P<plus>plus)|(?P<dot>dot|point)|(?P<digit>{_WORD})|(?P<number>[0-9]+)|(?P<gap>[\x20,.-]+)", re.IGNORECASE)
_BRACKET_AT = re.compile(r"\s?[\[({<]\s?(?:at|arroba)\s?[\])}>]\s?", re.IGNORECASE)
_BRACKET_DOT = re.compile(r"\s?[\[({<]\s?(?:dot|point|punkt|punto)\s?[\])}>]\s?", re.IGNORECASE)
_SPELLED_ADDRESS = re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]+(?P<at>\x20(?:at|AT|@)\x20|@)[A-Za-z0-9-]+(?:(?:\x20(?:dot|DOT)\x20|\.)[A-Za-z0-9-]+)+(?!\w)")
#: Last labels of addresses that may be spelled with bare words (fixed values).
_LAST = re.compile(r"[\x20.](?:com|org|net|edu|gov|info|io|co|de|fr|es|eu|uk|us|it|nl|ch|at|example)$", re.IGNORECASE)
_SPACED_DOT = re.compile(r"\x20(?:dot|DOT)\x20")
#: Without one of these no transducer changes a text.
_TRIGGER = re.compile(_HOMOGLYPH.pattern + r"|[\[({<]\s?(?i:at|arroba|dot|point|punkt|punto)\s?[\])}>]|\x20(?:at|AT|@)\x20[A-Za-z0-9-]+(?:\x20(?:dot|DOT)\x20|\.[A-Za-z0-9])|\x20(?:dot|DOT)\x20" + rf"|(?i:(?<!\w)(?:{_WORD}){_GAP}(?:{_WORD}|[0-9])(?:{_GAP}|[0-9]))")

Change = tuple[int, int, str]


class Traced:
    """A rewritten text, and for each of its characters where it stands in the source: start and end."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, changes: list[Change]) -> None:
        """Put strings in place of stretches; their characters stand for the whole stretch, or each for its own."""
        text, start, end, at = [], [], [], 0
        for a, b, new in changes:
            text += [self.text[at:a], new]
            one = len(new) == b - a
            start += self.start[at:a] + (self.start[a:b] if one else [self.start[a]] * len(new))
            end += self.end[at:a] + (self.end[a:b] if one else [self.end[b - 1]] * len(new))
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end = start + self.start[at:], end + self.end[at:]

    def source(self, span: Span) -> Span:
        return min(self.start[span[0] : span[1]]), max(self.end[span[0] : span[1]])


def _homoglyphs(text: str) -> list[Change]:
    """Only in words or numbers that hold an ASCII letter, digit or @ besides, or are full-width: foreign words stay."""
    out = []
    for word in re.finditer(r"\S+", text):
        hits = list(_HOMOGLYPH.finditer(word[0]))
        if hits and (any(c.isascii() and (c.isalnum() or c == "@") for c in word[0]) or all(ord(h[0]) >= 0xFF01 or h[0].isdigit() for h in hits)):
            out += [(word.start() + h.start(), word.start() + h.end(), HOMOGLYPHS[h[0]]) for h in hits]
    return out


def _digits(text: str) -> list[Change]:
    out = []
    for m in _SPELLED.finditer(text):
        for t in _TOKEN.finditer(m[0]):
            new = {"plus": "+", "dot": ".", "digit": DIGITS.get(t[0].lower(), ""), "number": t[0], "gap": ""}[t.lastgroup]
            if t.lastgroup != "number":
                out.append((m.start() + t.start(), m.start() + t.end(), new))
    return out


def _signs(text: str) -> list[Change]:
    out = [(*m.span(), "@") for m in _BRACKET_AT.finditer(text)] + [(*m.span(), ".") for m in _BRACKET_DOT.finditer(text)]
    for m in _SPELLED_ADDRESS.finditer(text):
        if m["at"].strip() != "@" and not _LAST.search(m[0]):
            continue
        if len(m["at"]) > 1:
            out.append((*m.span("at"), "@"))
        out += [(m.start() + d.start(), m.start() + d.end(), ".") for d in _SPACED_DOT.finditer(m[0])]
    out = sorted(set(out))
    return [c for i, c in enumerate(out) if not i or c[0] >= out[i - 1][1]]


def deobfuscated(text: str) -> Traced:
    traced = Traced(text)
    for transducer in (_homoglyphs, _digits, _signs):
        changes = transducer(traced.text)
        if changes:
            traced.rewrite(changes)
    return traced


def spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans by kind, and those that only the deobfuscated text shows."""
    base = detected(text)
    more: dict[str, list[Span]] = {k: [] for k in KINDS}
    if _TRIGGER.search(text):
        traced = deobfuscated(text)
        if traced.text != text:
            for kind, found in detected(traced.text).items():
                for span in found:
                    a, b = traced.source(span)
                    apart = all(b <= x or y <= a for x, y in more[kind])
                    if apart and all(b <= x or y <= a or (a <= x and y <= b and (a, b) != (x, y)) for x, y in base[kind]):
                        more[kind].append((a, b))
    return base, more


def listed(found: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(found[kind]))


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, digest of the base spans, all spans, how many the method added and how many there are."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base, more = spans(text or "")
                every = {k: base[k] + more[k] for k in KINDS}
                out.append((*(len(base[k]) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), sum(map(len, more.values())), sum(map(len, every.values()))))
            columns = zip(*out, strict=True) if out else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[f.split()[0] for f in _OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, _OUT)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of `text` replaced by its kind in brackets."""

    @F.pandas_udf("string")
    def cover(texts):  # noqa: ANN001, ANN202
        def one(text: str | None) -> str | None:
            if not text:
                return text
            base, more = spans(text)
            out, at = [], 0
            for a, b, kind in sorted((a, b, k) for k in KINDS for a, b in base[k] + more[k]):
                if a >= at:
                    out += [text[at:a], f"[{kind}]"]
                    at = b
                elif b > at:
                    at = b
            return "".join([*out, text[at:]])

        return texts.map(one)

    return docs.withColumn("text", cover("text"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
