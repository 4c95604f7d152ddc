"""Detection, validators, masking and wording, on values of our own."""
from tests.conftest import scan_texts
from pyspark.sql import functions as F

from shroud.functions.regex import to_java, NOT_BEFORE, NOT_AFTER, FULL_BOUNDARY
from shroud.operators import detect


def test_boundary_rewrite():
    assert to_java(r"\b\d{3}\b") == NOT_BEFORE + r"\d{3}" + NOT_AFTER
    assert to_java(r"\b[a-z.]+\b").startswith(FULL_BOUNDARY)   # '.' is not a word char
    assert to_java(r"\bsk-[A-Za-z0-9_-]{16,}\b").endswith(FULL_BOUNDARY)


def luhn_digit(body):
    """The digit that makes body + digit pass."""
    total = sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(reversed(body)))
    return str(-total % 10)


def iban(country, account):
    number = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{country}{98 - number % 97:02d}{account}"


CARD = "51051051" + "0510510" + luhn_digit("510510510510510")
GOOD_IBAN = iban("NL", "INGB0417164300")


def test_several_types_in_one_text(spark):
    r = scan_texts(spark, ["Write to lena.k@mail.zetamail.net and ops+7@zetamail.co.uk; file 219-09-9999 came from 172.31.9.200 today"])[0]
    assert r["hits"] == {"email": 2, "ssn": 1, "ip": 1}


def test_validators_decide_on_candidates(spark):
    spaced = " ".join(CARD[i:i + 4] for i in range(0, 16, 4))
    wrong = CARD[:-1] + str((int(CARD[-1]) + 1) % 10)
    texts = [f"paid with {spaced}", f"paid with {CARD}.", f"ticket {wrong}", f"to {GOOD_IBAN} by Monday",
             f"to {GOOD_IBAN[:2]}00{GOOD_IBAN[4:]} by Monday", "adapter 9C-B6-D0-11-22-33 up", "adapter 9C-B6-D0-11-22 down",
             "ring +1 (312) 555-0188", "lot 31255501881234", "the sk- prefix, an eyJ start, AKIA alone", " ", ""]
    got = [r["hits"] for r in scan_texts(spark, texts)]
    assert got[0] == got[1] == {"credit-card": 1} and "credit-card" not in got[2]
    assert got[3].get("iban") == 1 and "iban" not in got[4]
    assert got[5] == {"mac": 1} and "mac" not in got[6]
    assert got[7].get("phone") == 1 and "phone" not in got[8]
    assert got[9:] == [{}, {}, {}]


def token(prefix, n, letters="Zq7Wm2Kx9Tb4Rd6Yh3"):
    return prefix + (letters * 4)[:n]


def test_credentials_by_type(spark):
    lines = {"aws-key": [token("ASIA", 16, "Q7W2K9T4R6Y3")], "gh-token": [token("gho_", 36), token("ghs_", 40)],
             "api-key": [token("sk-", 24), token("xoxp-", 20, "12345678901"), token("AIza", 35), token("rk_live_", 24)],
             "jwt": [f"eyJ{token('', 20)}.eyJ{token('', 30)}.{token('', 27)}"]}
    for kind, values in lines.items():
        found = scan_texts(spark, values)
        assert [r["hits"].get(kind, 0) for r in found] == [1] * len(values), (kind, found)
    short = scan_texts(spark, [token("AKIA", 9, "Q7W2K9T4R6Y3"), token("ghp_", 10), token("sk-", 6)])
    assert all(r["hits"] == {} for r in short)


def test_word_boundaries_are_ascii(spark):
    # a letter outside ASCII is no word character: the number after it starts a word
    r = scan_texts(spark, ["ü219-09-9999", "x219-09-9999", "_219-09-9999", "lena@zetamail.net.k@zetamail.net"])
    assert [x["hits"] for x in r[:3]] == [{"ssn": 1}, {}, {}]
    assert r[3]["hits"] == {"email": 2}


def test_masks_and_sample_cap(spark):
    gh = token("ghp_", 36)
    r = scan_texts(spark, [f"marianne@zetamail.net mk@zetamail.net 172.31.9.200 9C:B6:D0:11:22:33 {gh} 219-09-9999"])[0]
    want = [("email", "m…e@zetamail.net"), ("email", "…@zetamail.net"), ("ip", "172.31.9.•"), ("mac", "9C:B6:D0:••:••:••"),
            ("gh-token", f"{gh[:6]}… ({len(gh)} chars)")]
    assert [w for w in want if w not in r["samples"]] == []
    assert not any(t == "ssn" for t, _ in r["samples"])
    many = " ".join(f"box{i % 7}@post{i % 7}.net" for i in range(21))
    r = scan_texts(spark, [many], cap=2)[0]
    assert r["hits"]["email"] == 21 and len(r["samples"]) == 2


def test_wording(spark):
    df = spark.createDataFrame([(0, "email a@b.com b@c.com ssn 123-45-6789 " + " ".join(
        f"u{i}@x{i}.org" for i in range(5)))], "uid bigint, text string")
    s = detect.with_scan(df, sample_cap=3)
    row = s.select(detect.summary(F.col("hits")).alias("s"), detect.inline(F.col("hits"), F.col("samples")).alias("i"),
                   detect.detail(F.col("hits"), F.col("suppressed"), F.col("samples")).alias("d")).first()
    assert row.s == "7 emails, 1 SSN"
    assert row.i.startswith("7 emails (…@b.com, …@c.com, …@x0.org, +4 more), 1 SSN")
    assert "  • 1 SSN (masked — not shown)" in row.d.split("\n")
    assert row.d.split("\n")[-1].startswith("  Values are masked here")


def test_luhn_iban_columns(spark):
    df = spark.createDataFrame([(CARD,), (CARD[:-1] + str((int(CARD[-1]) + 5) % 10),), (GOOD_IBAN,)], "v string")
    got = df.select(detect.luhn_ok(F.col("v")).alias("l"), detect.iban_ok(F.col("v")).alias("i")).collect()
    assert [r.l for r in got[:2]] == [True, False]
    assert got[2].i is True and got[0].i is not True


def test_hits_plus_suppressed_equal_findings(spark):
    """Every validated match is either counted or suppressed, never lost."""
    from tests.conftest import SF_SMALL
    from shroud.sources import fixtures
    fx = fixtures.fx_text(spark, SF_SMALL)
    s = detect.with_scan(fx, sample_cap=0)
    per_doc = s.select("doc_id", (F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, h: a + h["count"])
                                  + F.aggregate("suppressed", F.lit(0).cast("bigint"), lambda a, h: a + h["count"])).alias("n"))
    f = detect.findings(fx, ["doc_id"]).groupBy("doc_id").count()
    joined = per_doc.join(f, "doc_id", "left").select("n", F.coalesce("count", F.lit(0)).alias("c"))
    assert joined.where("n <> c").count() == 0
    assert joined.agg(F.sum("n")).first()[0] > 0
