"""Personal data: base spans against the patterns themselves, and spans of disguised data."""

from __future__ import annotations

import hashlib
import random
import re

from snapweave.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    }


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(5)
    for _ in range(20000):
        text = "".join(rnd.choice("aé.@1 2+-(0_%9\n") for _ in range(rnd.randint(0, 40)))
        assert pii.detected(text) == plain(text), text
    for _ in range(3000):
        text = " ".join(rnd.choice(["4111111111111111", "4111 1111 1111 1111", "1.2.3.4.5", "256.1.1.1", "a@b.c", "+1 (222) 333-4444", "x@y", "1.2.3", "a@b.c@d.e"]) for _ in range(4))
        assert pii.detected(text) == plain(text), text


def found(text):
    base, more = pii.spans(text)
    return {text[a:b] for k in pii.KINDS for a, b in base[k]}, {(k, text[a:b]) for k in pii.KINDS for a, b in more[k]}


def test_disguised():
    assert found("write to joe [at] mail [dot] example.com now")[1] == {("email", "joe [at] mail [dot] example.com")}
    assert found("write to joe at mail dot com now")[1] == {("email", "joe at mail dot com")}
    assert found("joe＠mail.com")[1] == {("email", "joe＠mail.com")}
    assert found("jое@mail.com, x")[1] == set() or ("email", "jое@mail.com") in found("jое@mail.com, x")[1]
    assert found("call plus one two two two three three three four four four four today")[1] == {("phone", "plus one two two two three three three four four four four")}
    assert ("ip", "one dot two dot three dot four") in found("host one dot two dot three dot four up")[1]
    assert found("4111 1111 1111 1111 ok") == ({"4111 1111 1111 1111"}, set())


def test_generated_disguises():
    """Every disguise of every kind is found, with exactly the stretch of the source that it takes, wherever it stands."""
    rnd = random.Random(11)
    wide = lambda t: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t)
    glyphs = {v: k for k, v in reversed(pii.HOMOGLYPHS.items()) if v.isalpha() and not k.isascii() and ord(k) < 0xFF01}
    spell = {d: [w for w, x in pii.DIGITS.items() if x == d and w not in ("un", "null", "oh")] for d in "0123456789"}
    word = lambda: "".join(rnd.choice("abcdefgmnpqrstvz") for _ in range(rnd.randint(3, 8)))
    for _ in range(1500):
        local, domain, last = word(), word(), rnd.choice(["com", "org", "de", "fr"])
        number = "".join(rnd.choice("0123456789") for _ in range(rnd.randint(9, 12)))
        address = [str(rnd.randint(0, 9)) for _ in range(4)]
        kind, hidden = rnd.choice(
            [
                ("email", f"{local} [at] {domain} [dot] {last}"), ("email", f"{local}(at){domain}(dot){last}"), ("email", f"{local} at {domain} dot {last}"), ("email", f"{local}＠{domain}.{last}"),
                ("email", wide(f"{local}@{domain}.{last}")), ("email", "".join(glyphs.get(c, c) if i == 1 else c for i, c in enumerate(local)) + f"@{domain}.{last}" if local[1] in glyphs else f"{local} @ {domain}.{last}"),
                ("phone", "plus " + " ".join(rnd.choice(spell[d]) for d in number)), ("phone", wide("+" + number)), ("ip", " dot ".join(rnd.choice(spell[d]) for d in address)), ("ip", wide(".".join(address))),
            ]
        )
        before, after = rnd.choice(["", "é: ", "say ", "日本 ", "x\n"]), rnd.choice(["", " now", ", then", "\n"])
        text = before + hidden + after
        base, more = pii.spans(text)
        assert (len(before), len(before) + len(hidden)) in more[kind] + base[kind], (kind, text, base, more)


def test_ordinary_text_stays():
    for text in ("look at the dot on the map. one two three", "un deux trois quatre", "Привет мир", "we met at noon (at last)", "", "a at b"):
        base, more = pii.spans(text)
        assert not any(base.values()) and not any(more.values()), text


def test_query(spark):
    rows = [(1, "a@b.cc é 1.2.3.4"), (2, None), (None, ""), (3, "x" * 300000 + "1" * 300000), (1, "a@b.cc é 1.2.3.4")]
    got = pii.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 5 and by[1].spans == "email:0:6,ip:9:16" and by[1].n_email == 1
    assert by[2].spans == "" and by[2].base_sha256 == hashlib.sha256(b"").hexdigest() and by[3].n_card == 0
    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in pii.op7_pii(spark, data).collect():
        assert r.base_sha256 == hashlib.sha256(pii.listed(plain(texts[r.doc_id])).encode()).hexdigest()
    assert "[email]" in pii.redacted(spark.createDataFrame([("to a@b.cc",)], "text string")).first().text
