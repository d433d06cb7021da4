"""Names behind every context, shapes of personal data, and the numbers people get."""

import pytest
from pyspark.sql import functions as F

from logquarry.functions.numbering import ranked
from logquarry.operators import learning, masking, shapes
from logquarry.session import settled

THREAD = (
    'Bodo TrialBodo Trial.07 Jun 09:12 AM( answered ).From"Probe Software GmbH"<help@probe-software.example>To"Vera Versuch"'
    "<v.versuch@kunde.example>Sehr geehrte Frau Versuch,das ist klar.Mit freundlichen Grüßen / Kind regards Bodo Trial | "
    "Team Lead Support Probe Software GmbH | Nebenstraße 7 | D-54321 Probestadt Tel. +49 40 7654321 | Web: "
    "https://www.probe-software.example Amtsgericht Probestadt HRB 54321 | Geschäftsführer: Hans-Otto Attrappe, Rita Fall"
    'Hinweise finden Sie hier. Von: Probe Software GmbH (help@probe-software.example)Gesendet: Montag An: "Vera Versuch"Betreff: Re:[## 77 ##]'
)


def frame(spark, texts):
    return spark.createDataFrame([("s", k + 1, t) for k, t in enumerate(texts)], "source_id string, line_no long, text string")


def masked_lines(spark, texts, known=None, **options):
    """(lines, dictionary, lines restored) of one text."""
    rows = frame(spark, texts)
    learned = settled(learning.learn(learning.blocks(rows)))
    found = settled(masking.segmented(rows, masking.Options(**options), learned.select("category", "value").distinct()))
    entries = settled(learning.dictionary(masking.keys(found), learned, known))
    masked = settled(masking.masked(found, entries))
    ordered = lambda df, c: [r[c] for r in df.orderBy("line_no").collect()]
    return ordered(masked, "masked"), {r["folded"]: r["token"] for r in entries.collect()}, ordered(masking.restored(masked, entries), "restored")


@pytest.mark.parametrize("text, want", [
    ("Geschäftsführer: Ulf und Sven Mustermann, Dr. Anna Probe", ["Sven Mustermann", "Ulf Mustermann", "Ulf", "Anna Probe"]),
    ("Tel 12345Inhaberin: Eva Probe | Ort", ["Eva Probe"]),
    ("Neue Nachricht Erika Muster <e@x.example>", ["Erika Muster"]),
    ('"Erika Muster (Example Corp)" <e@x.example>', ["Erika Muster"]),
    ('"Erika Muster from Example Werke" <e@x.example>', ["Erika Muster"]),
    ('"Muster, Erika" <e@x.example>', ["Erika Muster"]),
    ('"Example Werke AG" <e@x.example>', ["Example Werke AG"]),
    ("Buchhaltung <e@x.example> MAIL FROM:<a@x.example> RCPT TO:<b@x.example>", []),
    ("An: Erika Muster (e@x.example)", ["Erika Muster"]),
    ("Met vriendelijke groet\nPiet Jansen", ["Piet Jansen"]),
    ("Un saludo,\nIñigo Prueba", ["Iñigo Prueba"]),
    ("Med vänliga hälsningar Åsa Prov", ["Åsa Prov"]),
    ("Kind regards,--Tessa Fiktiv", ["Tessa Fiktiv"]),
    ("Viele Grüße\nDoris Dummy\nTechnik", ["Doris Dummy"]),
    ("Danke. MfG Karl Test", ["Karl Test"]),
    ("Mit freundlichen Gruessen\n\nDr. Karl von Test-Prob", ["Karl von Test-Prob"]),
    ("Mit freundlichen Grüßen  Beispiel Werke GmbH", []),
    ("Mit freundlichen GrüßenTessa FiktivTeam Lead", ["Tessa Fiktiv"]),
    ("Am Montag schrieb Erika Muster:", ["Erika Muster"]),
    ("Erika van Muster wrote", ["Erika van Muster"]),
    ("Gentile Sig.ra Inventata, grazie", ["Inventata"]),
    ("Sehr geehrter Herr Dr. Test,", ["Test"]),
    ("Thx Karla, ok", ["Karla"]),
    ("Vielen Dank Tessa,\n", ["Tessa"]),
    ("Thanks again,\nthe log", []),
    ("Hello Support-Team,", []),
    ("Hallo Jan-Christian!", ["Jan-Christian"]),
    ("Firmensitz: Musterburg. Am Fluss", ["Musterburg"]),
    ("Sitz der Gesellschaft: Musterburg am Probesee", ["Musterburg am Probesee"]),
])
def test_contexts(text, want):
    assert [v for _, part, v, of in learning.findings(text) if of is None] == want


@pytest.mark.parametrize("text, want", [
    ("Probe AG, Muster+Co GmbH & Co. KG", ["Probe AG", "Muster+Co GmbH & Co. KG"]),
    ("Trainee  Muster GmbH", ["Muster GmbH"]),
    ("score 3.2 (HAM) AG 1234, build 12345 / Active", []),
    ("Lange Straße 7, Musterweg 12a-14, Karl-Probe-Allee 3/4 Alter Markt 5", ["Lange Straße 7", "Musterweg 12a-14", "Karl-Probe-Allee 3/4", "Alter Markt 5"]),
    ("Firewall 2 Monitoring 2 Speicherplatz 50 GB Unterweg 12345", []),
    ("D-12345 Musterstadt Tel 12345 bytes", ["D-12345 Musterstadt"]),
    ("Weg, 20095 Probe an der Au\n20095 Messages", ["20095 Probe an der Au"]),
    ("size: 12345 Bytes, 35578 Messages queued", []),
    ("Amtsgericht Probe am See, HRB 12 B und Registergericht Test, VR 7x", ["Amtsgericht Probe am See, HRB 12 B", "Registergericht Test"]),
    ("HRB 4711UST-ID: DE123456789 CHE-123.456.789 ATU12345678", ["HRB 4711", "DE123456789", "CHE-123.456.789", "ATU12345678"]),
    ("DE89 3704 0044 0532 0130 00, DE89370400440532013001", ["DE89 3704 0044 0532 0130 00"]),
    ("Toll-Free: 0800 1234567 T: 030 111222333 t: 030 1112223", ["0800 1234567", "030 111222333"]),
    ("Local office 0800 1234567 Local: 12.05.2026 Direct: 2026-05-12", []),
    ("GrüßenTel : +49 30 1234567Leiter", ["+49 30 1234567"]),
    ("ab +49 (0) 30-123456, 0049 30 123456 Queue 0049123456789 +123", ["+49 (0) 30-123456", "0049 30 123456"]),
])
def test_shapes(text, want):
    taken, found = [], []
    for finder, gate in shapes.FINDERS:
        if finder is shapes.accounts or gate.search(text):
            for _, start, end in finder(text):
                if not any(a < end and start < b for a, b in taken):
                    taken.append((start, end))
                    found.append((start, text[start:end]))
    assert [v for _, v in sorted(found)] == want


def test_thread(spark):
    """A thread whose line breaks were lost: nothing personal is left, and all comes back."""
    (line,), tokens, back = masked_lines(spark, [THREAD])
    assert back == [THREAD]
    for gone in ("Bodo", "Trial", "Versuch", "Vera", "Hans-Otto", "Attrappe", "Rita", "Fall", "Probe Software", "Nebenstraße", "54321", "7654321", "Amtsgericht"):
        assert gone not in line
    full = tokens["bodo trial"]
    assert line.startswith(full + full + ".07 Jun") and "Team Lead Support" in line and "[## 77 ##]" in line
    assert f"Sehr geehrte Frau {tokens['versuch']}," in line and tokens["versuch"] == tokens["vera versuch"].replace("PERSON", "NAME")
    assert "Tel. [TEL-001]" in line and "| [STRASSE-001] | [ORT-001] Tel." in line


def test_log_lines_stay(spark):
    lines = [
        "Mon 2026-08-26 10:15:01.123: Session 0012345678; child 1; thread 4211",
        "Mon 2026-08-26 10:15:02.002: Date: Wed, 29 Apr 2026 09:51:00 +0200",
        "Mon 2026-08-26 10:15:02.006: Queue ID 0049123456789 Retry 00 14 22 33 44",
        "see Task 30927.Regards and this Feature.Mit freundlichen Grüßen",
    ]
    assert masked_lines(spark, lines)[0] == lines


def test_numbers_by_first_appearance(spark):
    """Full names first, then surnames, then first names of each source; parts share the number of their person."""
    texts = {
        "a": "Hallo Ulf,\nSehr geehrte Frau Neu,\nViele Grüße\nEva Probe",
        "b": "An: \"Ulf Neu\" <u@x.example>\nAn: \"Eva Probe\" <e@x.example>\nHallo Eva,\nHallo Zoe!",
    }
    learned = settled(learning.learn(spark.createDataFrame(list(texts.items()), "source_id string, text string")))
    got = {r["key"]: r["token"] for r in learning.person_numbers(learned).collect()}
    assert got == {
        "Eva Probe": "[PERSON-001]", "Probe": "[NAME-001]", "Neu": "[NAME-002]", "Ulf": "[VORNAME-003]",
        "Ulf Neu": "[PERSON-004]", "Eva": "[VORNAME-001]", "Zoe": "[VORNAME-005]",
    }
    known = spark.createDataFrame([("Person", "eva probe", "Eva Probe", "[PERSON-009]"), ("Person", "xy", "Xy", "[NAME-009]")], "category string, folded string, key string, token string")
    more = {r["key"]: r["token"] for r in learning.person_numbers(learned, known).collect()}
    # The surname's token is taken, so it opens a number where it stands.
    assert more == {"Probe": "[NAME-010]", "Neu": "[NAME-011]", "Ulf": "[VORNAME-012]", "Ulf Neu": "[PERSON-013]", "Eva": "[VORNAME-009]", "Zoe": "[VORNAME-014]"}


def test_ranks(spark):
    """Numbers over ranges of a skewed key, for each group anew."""
    rows = [("x" if k % 3 else "y", "hot" if k % 4 else f"s{k}", k * 7919 % 1000) for k in range(1000)]
    df = spark.createDataFrame(rows, "g string, source string, n long").repartition(5)
    got = {(r["g"], r["source"], r["n"]): r["number"] for r in ranked(df, ["source", "n"], within="g").collect()}
    want = {}
    for g in "xy":
        for k, r in enumerate(sorted(r for r in rows if r[0] == g), 1):
            want[r] = k
    assert got == want
    assert ranked(df.limit(0), ["source", "n"]).collect() == []
    plan = ranked(df, ["source", "n"], within="g")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Exchange SinglePartition" not in plan


def test_folding(spark):
    """Keys are compared as Python's casefold compares them."""
    values = ["STRASSE", "straße", "STRAẞE", "ΣΑΣ", "σας", "ﬁx", "FIX", "ſ", "İ", None, "abc"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", masking.fold(F.lit("Extra"), F.col("v")).alias("f")).collect()
    assert all(r["f"] == (r["v"] and r["v"].casefold()) for r in rows)


def test_dates_and_numbers(spark):
    """Dates are told from numbers alike in columns and in texts."""
    from logquarry.functions import identifiers as ids

    values = "2026-10-15 10:00|15.10.2026|+(2026/01/02|1899-10-15|2026-13-01|15.10.26 1234|030 4445556|2026-1-15|12.05.20267|x|1-2-3|20261015|15-10-2126|(0)30-12-2010".split("|")
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", ids.begins_as_date(F.col("v")).alias("d")).collect()
    assert {r["v"]: r["d"] for r in rows} == {v: shapes.is_date(v) for v in values}
    assert {v for v in values if shapes.is_date(v)} == {"2026-10-15 10:00", "15.10.2026", "+(2026/01/02", "12.05.20267"}


def test_only_texts_that_may_hold_a_phrase_are_cut_into_tokens(monkeypatch):
    made = []
    whole = learning.tokens
    monkeypatch.setattr(learning, "tokens", lambda text: made.append(text) or whole(text))
    assert learning.findings("An item to be sold from best to last, mit many things of the von kind: one.") == []
    assert not made
    assert [f[2] for f in learning.findings("so schrieb Erika Muster\nVon : Max Beispiel <m@x.example>")] == ["Max Beispiel", "Beispiel", "Max Beispiel", "Beispiel", "Erika Muster", "Muster"]
    assert made
