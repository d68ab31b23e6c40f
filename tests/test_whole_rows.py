"""Queries over every row, against brute force in Python."""

import hashlib
import re
import time
import unicodedata

import __spark_entry__ as e
from ledgerloom.functions import protect
from ledgerloom.plans.mapping_queries import TERMS

TEXTS = [
    None, "", "Rs. 500 by cheque  book , A/c ( 12 ) / x", "₹ 5 और Rs.५०० दिये , चेक / नकद", "खाताcheque book कुpass book।", "“e-mail” ; Rs 5  , ( a　)", "pass book a/C E-MAIL chequé cheque book2",
    "O5 and 1l, ₹O5 5I", "कO5 ५l 5lक कुO5 5lा", "é5l O5é", "  1O,5OO.0l on l2/O3/2O24 ", "ABCPEL234F A8CPE12E4F ABCPED234F HDFCO12345I HDFC112345I",
]
NAMES = [None, "", "Bank of India", "बैंक Of India", "BANQUE ÉTÉ", "Été Bank", "क़ Bank"]
REFS = [None, "", "AB5D0123456789O1", "AXISR5202401010123456O", "AXISR12345678901234567", "O12345678S12", "AXIS-0123 4567_8901", "x"]


def md5(text):
    return None if text is None else hashlib.md5(text.encode()).hexdigest()


def harmonised(t):
    for pattern, word in protect.HARMONISED:
        t = re.sub(pattern, word, t, flags=re.I)
    return t


def cleaned(t):
    return re.sub(r"\s*/\s*", "/", re.sub(r"([(\[])\s+", r"\1", re.sub(r"\s+([,.;:)\]])", r"\1", t)))


def repaired(t):
    """By the kind of each word: numbers with separators, tax numbers, routing codes."""
    letters, digits, misread = str.maketrans("01582", "OISBZ"), str.maketrans("OILSBZ", "011582"), str.maketrans("OoIlSB", "001158")

    def fix(w):
        if re.fullmatch(r"[0-9OoIlSB]*[0-9][0-9OoIlSB]*([.,/-][0-9OoIlSB]+)+", w):
            return w.translate(misread)
        if re.fullmatch("[A-Z0-9]{10}", w):
            x = w[:5].translate(letters) + w[5:9].translate(digits) + w[9:].translate(letters)
            return x if re.fullmatch("[A-Z]{3}[ABCFGHJLPT][A-Z][0-9]{4}[A-Z]", x) else w
        if re.fullmatch("[A-Z0-9]{11}", w):
            x = w[:4].translate(letters) + "0" + w[5:]
            return x if re.fullmatch("[A-Z]{4}0[A-Z0-9]{6}", x) and w[4] not in "123456789" else w
        return w

    return " ".join(fix(w) for w in t.strip(" ").split(" "))


def rate(name):
    x, y = [unicodedata.normalize("NFC", v) for v in (name.lower(), name)]
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, q in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
    return row[-1] / len(x) if x else 0.0


def run(spark, tmp_path, query, name, schema, rows):
    spark.createDataFrame(list(enumerate(rows)), schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = e.queries()[query](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    return {r[0]: tuple(r)[1:] if len(r) > 2 else r[1] for r in got}


def whole(f, rows):
    return {i: None if t is None else f(t) for i, t in enumerate(rows)}


def test_harmonize(spark, tmp_path):
    assert run(spark, tmp_path, "harmonize", "documents", "doc_id int, text string", TEXTS) == whole(lambda t: md5(harmonised(t)), TEXTS)


def test_clean_legal_text(spark, tmp_path):
    assert run(spark, tmp_path, "clean_legal_text", "documents", "doc_id int, text string", TEXTS) == whole(lambda t: md5(cleaned(t)), TEXTS)


def test_critical_repair(spark, tmp_path):
    assert run(spark, tmp_path, "critical_repair", "text_spans", "span_id int, text string", TEXTS) == whole(repaired, TEXTS)


def test_cer(spark, tmp_path):
    assert run(spark, tmp_path, "cer", "detections", "detection_id int, bank_name string", NAMES) == whole(rate, NAMES)


def test_utr_repair(spark, tmp_path):
    got = run(spark, tmp_path, "utr_repair", "statement_rows", "row_id int, reference_number string", REFS)
    want = [(None, None), ("", None), ("ABSD012345678901", "NEFT"), ("AXISR52024010101234560", "RTGS"), ("AXISR12345678901234567", "RTGS"), ("012345678512", "UPI"), ("AXIS012345678901", "NEFT"), ("X", None)]
    assert got == dict(enumerate(want))


TERMED = [
    None, "", "none of them", "Fixed deposit fixed deposit", "Fixed Deposit, fixed deposit", "cheque  book", "cheque\nbook cheque book\r\n", "home loan withdrawal", "İncome tax", "banK LOAN", "taxes _tax tax2 untaxed", "खाताtaxकर",
    "\U0001f600tax\U0001f600interest rate\U0001f600interest rate", "savings account statement", "account statement account", "current account current account current account", "Power of attorney in the High Court; petition, notice.",
]


def terms(t):
    """As the SQL has it: a term of several words is cut out before the next one is looked for."""
    rest, found = (t or "").replace("İ", "i").lower(), []
    for term in sorted(TERMS, key=lambda x: (-len(x), x)):
        p = rf"(\A|[^A-Za-z0-9_]){term}(\Z|[^A-Za-z0-9_])"
        found += [term] * bool(re.search(p, rest))
        rest = re.sub(p, r"\1#\2", rest) if " " in term else rest
    return ",".join(found)


def test_join_glossary(spark, tmp_path):
    assert run(spark, tmp_path, "join_glossary", "documents", "doc_id int, text string", TERMED) == {i: terms(t) for i, t in enumerate(TERMED)}


def test_join_glossary_goes_through_a_text_few_times(spark, tmp_path):
    """3 MB, for which hundreds of passes took minutes."""
    began = time.time()
    assert run(spark, tmp_path, "join_glossary", "documents", "doc_id int, text string", [("the bank खाता संख्या and branches " * 1000) + "home loan"] * 90) == dict.fromkeys(range(90), "home loan")
    assert time.time() - began < 30
