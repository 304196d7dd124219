"""Files, mail and dictionaries on small fixtures."""

import hashlib
import hmac
from email.message import EmailMessage

from lakefolio.operators import matching
from lakefolio.plans import registry
from lakefolio.sources import files, mail

KEY = b"k"


def test_files(spark, tmp_path):
    given = {
        "a.bin": b"\x89PNG\r\n\x1a\nxx", "b.png": b"junk %PDF-1.7", "c.jpg": b"\xff\xd8\xff\xe0", "d.tif": b"MM\0*", "e.webp": b"RIFF1234WEBPVP8",
        "f.txt": b"plain", "g.pdf": b"", "h.pdf": b"%PDF-1.7 x", "i.pdf": b"%PDF-1.7 x",
    }
    for name, content in given.items():
        (tmp_path / name).write_bytes(content)
    rows = files.parts(files.files(spark, str(tmp_path)), KEY)
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.digest) for r in rows.collect()}
    empty = spark.createDataFrame([("g.pdf", 0, b""), ("n", None, None)], "path string, length long, content binary")
    assert [r.kind for r in files.parts(empty, KEY).collect()] == [None, None]
    assert given.pop("g.pdf") == b""  # the scan leaves empty files out
    kinds = dict(zip(given, ["png", "pdf", "jpeg", "tiff", "webp", None, "pdf", "pdf"]))
    assert got == {n: (kinds[n], hmac.new(KEY, c, hashlib.sha256).hexdigest()) for n, c in given.items()}
    fresh = files.register(rows, rows.filter("path LIKE '%a.bin'"))
    assert sorted(r.path.rsplit("/", 1)[1] for r in fresh.collect()) == ["b.png", "c.jpg", "d.tif", "e.webp", "f.txt", "h.pdf"]


def test_mail(spark):
    def message(sender, text, markup=None, attachment=None, mark=None):
        m = EmailMessage()
        m["From"], m["Subject"] = sender, "Über"
        if mark:
            m["Message-ID"] = mark
        m.set_content(text)
        if markup:
            m.add_alternative(markup, subtype="html")
        if attachment:
            m.add_attachment(attachment, maintype="application", subtype="pdf", filename="x.pdf")
        return m.as_bytes()

    only_markup = b"From: C <c@else.org>\nContent-Type: text/html; charset=nonsense\n\n<p>one</p><p>two</p>"
    rows = [
        ("1", message("A <A@Example.org>", "plain", "<p>markup</p>", b"%PDF-", "<m1>")), ("2", message("b@example.org", "again", mark="<m1>")),
        ("3", only_markup), ("4", b""), ("5", None),
    ]
    got = mail.messages(spark.createDataFrame(rows, "path string, content binary"))
    by = {r.path: r for r in got.collect()}
    assert len(by) == 5
    assert (by["1"].sender, by["1"].subject, by["1"].text.strip()) == ("a@example.org", "Über", "plain")
    assert [tuple(a) for a in by["1"].attachments] == [("x.pdf", "application/pdf", 5)]
    assert by["3"].text.strip() == "one\ntwo"
    assert by["4"].sender is None and by["5"].sender is None
    entries = spark.createDataFrame([("@EXAMPLE.org",), ("c@else.org",)], "entry string")
    assert sorted(r.path for r in mail.allowed(got, entries).collect()) == ["1", "2", "3"]
    assert sorted(r.path for r in mail.once(got, KEY).collect()) == ["1", "3", "4", "5"]


def plain_ratio(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        last = row
        row = [0]
        for j, d in enumerate(b):
            row.append(last[j] + 1 if c == d else max(last[j + 1], row[j]))
    return 200.0 * row[-1] / (len(a) + len(b)) if a and b else 100.0 * (a == b)


def test_ratio():
    words = ["", "a", "ab", "ba", "abcab", "fahrzeug", "fahrzeuge", "fahrseug", "zeug", "aaaaabaaaa", "b" * 80, "b" * 40 + "a" * 40]
    for a in words:
        for b in words:
            assert matching.ratio(a, b) == plain_ratio(a, b)


def test_lookup(spark):
    names = ["VEHICLE", "kfz", "Fahr-Zeug", "Fahrzeugs", "Haus", None, "", "Vehicle"]
    rows = spark.createDataFrame([(n, 1) for n in names], "name string, entry int")
    got = matching.lookup(rows, "name", {"Vehicle": ["KFZ", "Fahrzeug"], "Tax": ["Steuer"]}).collect()
    assert sorted(((r.name, r.match, r.how, r.entry) for r in got), key=str) == sorted([
        ("VEHICLE", "Vehicle", "name", 1), ("kfz", "Vehicle", "alias", 1), ("Fahr-Zeug", "Vehicle", "folded", 1), ("Fahrzeugs", "Vehicle", "near", 1),
        ("Haus", None, None, 1), (None, None, None, 1), ("", None, None, 1), ("Vehicle", "Vehicle", "name", 1),
    ], key=str)


def test_lookup_on_table(spark):
    got = registry.QUERIES["tag_lookup"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 100 and {r.how for r in got} >= {"name", "folded"}
