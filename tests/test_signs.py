"""Lists of patterns behind their signs against the same lists without them."""

import random

from pyspark.sql import functions as F

from paperloom.functions import quality, signs
from paperloom.operators import pagechain, refined, segment, table_functions
from paperloom.plans import corpus

LISTS = {
    **{k: (v, "i") for k, v in segment.GROUPS.items()}, "aggressive": (segment.AGGRESSIVE, "im"), "mail": (pagechain.EMAIL_SIGNS, "imd"), "basic": (pagechain.BASIC_SIGNS, "imd"),
    "start": (pagechain.START_PATTERNS, "imd"), "form": (pagechain.FORM_SIGNS, "imd"), "goes_on": (refined.GOES_ON, "id"), "quotes": (refined.QUOTES, "imd"), "weak": (refined.WEAK_SIGNS, "imd"),
    **{p: ((p,), "imd") for p in (pagechain.EMAIL_HEADER, pagechain.QUOTED_MAIL, pagechain.INVOICE_LIKE, pagechain.PAYMENT_LIKE, pagechain.SHEET, pagechain.SECTION)},
}
PIECES = (
    "From: a@b.com To: c@d.org Subject: Sent: Monday, May 3 2020 10:15 AM Fram Ta lo 1/2/2021 12:30 SUBM1TTAL TRANSMITTAL Reference Number APPL1CATION PAYMENT A1A Document Packing Slip sales order "
    "RF1 # 7 request INFORMATION Cost proposal C.O. CO 12 PCO SCALE: SHEET 3 OF 9 detail Page 1 of 4 Invoice#1 RE: Fwd: ----- _____ wrote: On Original Message > Dear MEMO A1.2 P.O. Box Date: Project #: "
    "İ K ſ ß \x0b \r Continued from See attached continuation sheet - 5 - STRUCTURAL ENGINEERING DWG 4 schedule of values"
).split(" ") + ["From: a To: b Subject:", "schedule of values", "P.O. Box", "Attention:"]


def test_lists_behind_signs_hit_as_without(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(PIECES) + rng.choice([" ", " ", "\n", "", "\r\n"]) for _ in range(rng.randint(0, 6))) for _ in range(3000)]
    texts = [rng.choice([str.upper, str.lower, str, str.title])(t) for t in texts]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for name, (patterns, flags) in LISTS.items():
        plain = F.col("t").rlike(f"(?{flags})" + "|".join(f"(?:{p})" for p in patterns))
        n, wrong = rows.select(F.count_if(plain), F.count_if(~plain.eqNullSafe(signs.has_any(F.col("t"), patterns, flags)))).first()
        assert wrong == 0 and n, name


def test_signs_of_patterns():
    assert signs.signs(r"From:\s*.*@") == {"from:"} and signs.signs(r"[\w\s]+@[\w\.]+\.(com|org)") == {"@"}
    assert signs.signs("(Monday|Tues?day)") == {"monday", "tue"} and signs.signs(r"SUBM[I1]TTAL") == {"subm"}
    assert not signs.signs(r"^[A-Z\s]{10,}$") and not signs.signs("ab?|c*") and not signs.signs(r"(?:RFI)?\s*\d+") and not signs.signs("(?!RE:)")
    assert signs.signs(r"ab{0,2}c{2}") == {"a"}


def test_repairs_behind_signs_equal_all_in_turn(spark):
    rng = random.Random(5)
    terms = "RFl rf1 RFI C0 CO. co AS1 PC0 ccd SUBMlTTAL INVOlCE lnvoice P0 po DSA D1R pwc GEN3RAL  C0NTRACTOR SUBC0NTRACTOR ARCH1TECT ENGlNEER C0NSTRUCTl0N BU1LDING PR0JECT GENERAL contractor".split(" ")
    numbers = "O1/ o5- 01- 1O/ 1o- 10/ 2O2O 2o21 2025 2O26 O1/O2/2O24 l2/3l/2O23 1O-l1-24 OO/l/2024 lO/OI/99 O9-lO-2022 O1-02-03-O4 / - l O 202l İ ſ".split(" ")
    texts = ["".join(rng.choice(rng.choice((terms, numbers))) + rng.choice([" ", " ", "\n", "", "-", "/", "\r\n"]) for _ in range(rng.randint(0, 7))) for _ in range(6000)]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    plain = quality.strip(F.regexp_replace(quality._replaced(quality._replaced(F.col("t"), quality.TERM_REPAIRS, "(?i)"), quality.DATE_REPAIRS, ""), r"\s+", " "))
    got = quality.repair_terms(F.col("t"))
    bad = rows.select("t", plain.alias("a"), got.alias("b")).where("not (a <=> b)").limit(5).collect()
    assert not bad, bad


def test_few_texts_are_rendered_by_many_tasks(spark, tmp_path):
    spark.range(40).selectExpr("id as c_custkey", "'Customer#' || id as c_name").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(400).selectExpr("id as o_orderkey", "id % 40 as o_custkey", "1.5d as o_totalprice", "timestamp'2024-01-02' as o_orderdate").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = corpus.rendered(spark, str(tmp_path)).select("text", F.spark_partition_id().alias("part")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(texts) == 400 and len({r.part for r in texts}) >= 6


def test_texts_without_a_sign_have_no_match(spark):
    table_functions.register(spark)
    texts = ["CONTRACT No. C-7 and $1,200.00", "Invoice #12 RFI 7 a@b.org", "nothing", "", None, "\u212aontract contract#Z9", "$ 5 Change Order 3 PO 9 Project Number: P-4"]
    for family in table_functions.PATTERNS:
        rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("may", table_functions.possible(F.col("text"), family))
        hit = {r.id for r in spark.sql(f"SELECT id FROM {{rows}}, LATERAL extract_patterns(text, '{family}')", rows=rows).collect()}
        may = {r.id for r in rows.where("may").collect()}
        assert hit <= may, family
        if family in ("amount", "reference contract"):
            assert hit and 2 not in may and 3 not in may
