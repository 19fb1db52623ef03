import hashlib
import random
import re
import time

import pytest

from featloom.llm import personal as pd

IBAN = "GB82 WEST 1234 5698 7654 32"


def brute(text):
    """The base finds as the plain patterns give them."""
    out = [(*m.span(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c not in " -"]
        total = sum(sum(divmod(d * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((*m.span(), 2))
    out += [(*m.span(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return [(s, e, pd.KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def test_base_finds_equal_the_plain_patterns():
    rng = random.Random(13)
    alphabets = ["a@.1", "1234567890 -.", "+1() 5.-", "a@b.c_%é", "0. 25", "٣4１ 2"]
    for _ in range(20_000):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 60)))
        assert pd.base_spans(text) == brute(text), text


@pytest.mark.parametrize("unit", ["a", "1", "1 ", "a@", "@a", "1.", "+1(", "AB12", "DE12 ", "a.", "(555)"])
def test_long_odd_texts_take_linear_time(unit):
    text = unit * (400_000 // len(unit))
    start = time.perf_counter()
    pd.personal_spans(text)
    assert time.perf_counter() - start < 4


def kinds(text):
    return [f.kind for f in pd.personal_spans(text)]


def test_checksums_confirm_or_end_proposals():
    assert kinds(f"x {IBAN} y") == ["iban"] and kinds(f"x {IBAN[:-1]}3 y") == []
    assert kinds("DE89370400440532013000") == ["iban"] and kinds("DE89370400440532013000X") == []
    assert kinds("12345678Z") == ["dni"] and kinds("12345678A") == []
    assert kinds("4111 1111 1111 1111") == ["card"] and kinds("4111 1111 1111 1112") == []
    nir = "1510824563214"
    assert kinds("clé " + nir + f"{97 - int(nir) % 97:02d}")[-1:] == ["nir"] or "card" in kinds(nir + f"{97 - int(nir) % 97:02d}")


def test_context_decides_weak_proposals():
    assert kinds("social security 078-05-1120") == ["ssn"] and kinds("078-05-1120") == []
    assert kinds("call (555) 123-4567 now") == ["tel"] and kinds("part (555) 123-4567") == []
    near, plain, other = (pd.score(t, len(t), len(t), "card", True) for t in ("visa ", "word ", "order "))
    assert near > plain > other


def test_further_finds_do_not_overlap_others_and_base_ones_stay():
    text = "call +1 555-123-4567 or 555-123-4567, iban 10.0.0.1 card 4111111111111111"
    found = pd.personal_spans(text)
    assert [(f.start, f.end, f.kind) for f in found if f.kind in pd.BASE] == brute(text)
    assert [f.kind for f in found] == ["phone", "tel", "ip", "card"]
    assert pd.redact(text, found) == "call <phone> or <tel>, iban <ip> card <card>"


def test_rows_nulls_and_clashing_names(docs_of, spark):
    rows = [(1, None), (2, ""), (3, "mail a.b@c.de!"), (3, "mail a.b@c.de!"), (None, "é +1 (743) 555-3824 " + "w" * 50_000), (5, IBAN)]
    docs = docs_of(rows).selectExpr("*", "1 AS personal", "named_struct('a b', 1) AS odd")
    out = {(r.doc_id, r.text): r for r in pd.find_personal(docs, redacted=True).collect()}
    assert out[1, None]["_personal"] == [] and out[1, None].redacted is None and out[2, ""].redacted == ""
    assert [(f.start, f.end, f.kind) for f in out[3, "mail a.b@c.de!"]["_personal"]] == [(5, 13, "email")]
    assert out[3, "mail a.b@c.de!"].redacted == "mail <email>!" and out[5, IBAN].personal == 1
    assert [(f.start, f.end) for f in out[None, rows[4][1]]["_personal"]] == [(2, 19)]
    assert pd.find_personal(docs.limit(0)).count() == 0 and len(out) == 5


def test_query_equals_brute_force_on_the_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = {r.doc_id: r for r in pd.op13_personal_data(spark, sf_dir).collect()}
    assert out.keys() == texts.keys()
    for i, text in texts.items():
        base = brute(text)
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert out[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in pd.BASE] == [sum(b[2] == k for b in base) for k in pd.BASE]
        assert set(joined.split(",")) <= set(out[i].spans.split(","))
