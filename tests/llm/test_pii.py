import hashlib
import re

from pyspark.sql import functions as F

from tallyworks.llm import pii

from .fixtures import documents, frame

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CASES = [
    "mail me: jo.do+x@ex-1.example.co.uk, or _a@b.c_d@e.f.g!", "a@b a@b. @c.d x@y.z@w.v", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3", "0000000.1.1.1 1..2.3.4",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 x 4111111111111111-", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "+1 (487) 555-7209 +1 +12 +1.2 +1 ...2 +4() 12345678", "+1234567890123456",
    "𝒳𝒳 é 79927398713 0000000000000 ü4111111111111111ü", "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, DE89370400440532013001", 'token = "bee4a2827eb113d73cb298acc0f727ef99bdc461"',
    "ssn 123-45-6789; 123-45-6789x and far away ................................................ 123-45-6780", "", None, " ".join(f"u{k}@h{k}.org 10.0.0.{k}" for k in range(700)), "a" * 50000 + "@", "1" * 20000 + " " + "9." * 3000, "x@" + "y." * 5000 + "z",
]


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(len(x.lstrip("0")) < 4 and int(x[-4:] if len(x.lstrip("0")) < 4 else 999) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def table(spark):
    return spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string").withColumns({"pii": F.lit(1), "spans": F.lit(2)})


def test_base_spans_against_python(spark):
    got = {r.doc_id: r.pii for r in pii.find(table(spark)).collect()}
    for k, t in enumerate(CASES):
        assert [(s.kind, s.start, s.end) for s in got[k] if s.base] == brute(t), t and t[:60]


def test_method_adds_confirmed_spans(spark):
    got = {r.doc_id: [(s.kind, CASES[r.doc_id][s.start : s.end]) for s in r.pii if not s.base] for r in pii.find(table(spark)).collect()}
    assert got[9] == [("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "DE89370400440532013000")]
    assert got[10] == [("secret", "bee4a2827eb113d73cb298acc0f727ef99bdc461")]
    assert got[11] == [("ssn", "123-45-6789")] * 2  # both have "ssn" within 48 code points before them


def test_redaction(spark):
    got = {r.doc_id: r.text for r in pii.redact(table(spark)).collect()}
    for k, t in enumerate(CASES):
        spans = sorted((s.start, s.end, s.kind) for s in pii.find(table(spark).where(f"doc_id = {k}")).first().pii) if k in (0, 4, 8, 10) else None
        if spans is not None:
            want, at = "", 0
            for a, b, kind in spans:
                if a >= at:
                    want += t[at:a] + f"[{kind.upper()}]"
                at = max(at, b)
            assert got[k] == want + t[at:]
    assert got[12] == "" and got[13] is None
    assert got[14].count("[EMAIL]") == 700


def test_query_digest_on_documents(spark, sf_dir):
    from tallyworks.llm.common import read_table

    texts = {r.doc_id: r.text for r in read_table(spark, sf_dir, "documents").collect()}
    for r in pii.op2_pii(spark, sf_dir).collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for n, *_ in want) for k in PLAIN]


def test_native_plan_and_empty(spark):
    df = pii.redact(frame(spark, documents()))
    assert not re.search("Python|Arrow|Exchange", df._jdf.queryExecution().executedPlan().toString())
    assert df.columns == frame(spark, []).columns and pii.redact(frame(spark, [])).count() == 0


HEX = "9233A8ECF7C5014BD2E6"
NEAR = [
    (f"tokens: {(HEX.lower() * 2)[:32]}, {(HEX.lower() * 2)[8:]}", ["secret"] * 2, "tokens: [SECRET], [SECRET]"),
    ("SSN 123-45-6789, 223-45-6789", ["ssn"] * 2, "SSN [SSN], [SSN]"),
    ("123-45-6789, 223-45-6789 𝒳 ssn", ["ssn"] * 2, "[SSN], [SSN] 𝒳 ssn"),
    ("ssn " + "." * 44 + "123-45-6789 " + "." * 60 + "223-45-6789", ["ssn"], "ssn " + "." * 44 + "[SSN] " + "." * 60 + "223-45-6789"),
]


def test_neighbours_do_not_hide_context(spark):
    df = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(NEAR)], "doc_id long, text string")
    assert [[s.kind for s in r.pii] for r in pii.find(df).orderBy("doc_id").collect()] == [kinds for _, kinds, _ in NEAR]
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == [clean for *_, clean in NEAR]


def test_secrets_in_capitals_and_long_ones(spark):
    texts = [f'TOKEN = "{HEX * 2}"', f"secret {HEX.lower() * 7}", f"Token {HEX}{HEX.lower()}", f"token {HEX * 2}G", f"no hint {HEX * 2}", f"token {HEX}"]
    got = pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.text for r in got] == ['TOKEN = "[SECRET]"', "secret [SECRET]", "Token [SECRET]", *texts[3:]]


def test_names_of_its_own(spark):
    own = ["__text", "__m_email", "__g_ip", "__chunks", "___e_card", "__ordered", "__reach", "a.b"]
    df = spark.createDataFrame([(1, "mail a@b.cc now"), (1, None)], "doc_id long, text string").withColumns({c: F.lit(c) for c in own})
    for got in (pii.find(df), pii.redact(df)):
        assert [tuple(r[c] for c in own) for r in got.collect()] == [tuple(own)] * 2
    assert pii.redact(df).columns == df.columns and [r.text for r in pii.redact(df).collect()] == ["mail [EMAIL] now", None]


def test_scores_and_long_texts_in_chunks(spark):
    import random

    rng, texts = random.Random(4), []
    for k in range(30):
        parts = [rng.choice(["x" * rng.randrange(1500), "𝒳é " * rng.randrange(400), "\n", f"ip 10.0.0.{k} ", f" u{k}@h.org ", " ssn 123-45-6789 ", "+49 (89) 123-456-78 ", "phone "]) for _ in range(40)]
        texts.append("".join(parts))
    rows = pii.redact(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()
    kinds = {k.name: k for k in pii.KINDS}
    for t, r in zip(texts, rows, strict=True):
        want, at = "", 0
        for s in sorted(r.pii, key=lambda s: (s.start, s.end, s.kind)):
            near = t[max(0, s.start - pii.BEFORE) : s.start] + "\n" + t[s.end : s.end + pii.AFTER]
            assert s.score == min(1.0, round(kinds[s.kind].score + (pii.BOOST if re.search(kinds[s.kind].context, near, re.IGNORECASE) else 0), 2))
            if s.start >= at:
                want += t[at : s.start] + f"[{s.kind.upper()}]"
            at = max(at, s.end)
        assert r.text == want + t[at:]


def test_time_in_proportion_to_spans(spark):
    import time

    took = []
    for n in (4000, 16000):
        df = spark.createDataFrame([(1, " ".join(f"u{k}@h.org 10.0.0.1" for k in range(n)))], "doc_id long, text string")
        begun = time.perf_counter()
        assert pii.redact(df).first().text.count("[EMAIL]") == n
        took.append(time.perf_counter() - begun)
    assert took[1] < 10 * took[0] + 2


def test_running_figures(spark):
    values = [(list(range(n)),) for n in (0, 1, 5, 40, 700)]
    df = spark.createDataFrame(values, "v array<bigint>")
    got = df.select(pii.running(F.col("v"), lambda a, x: a + x, F.lit(0).cast("long"), 4).alias("s"), pii.running(F.transform("v", lambda x: x % 7), lambda a, x: F.greatest(a, x), F.lit(0).cast("long"), 4).alias("m")).collect()
    for (v,), r in zip(values, got, strict=True):
        assert r.s == [sum(v[: k + 1]) for k in range(len(v))] and r.m == [max(x % 7 for x in v[: k + 1]) for k in range(len(v))]
