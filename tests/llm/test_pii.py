import hashlib
import re

from pyspark.sql import functions as F

from panelwright.llm import pii
from panelwright.llm.queries import QUERIES, table


def luhn(digits):
    values = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def bare(text):
    return re.sub("[^0-9]", "", text)


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(bare(m)) <= 19 and luhn(bare(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(bare(m)) <= 15),
}


def plain(text):
    spans = sorted((m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, (pattern, good)) in enumerate(PLAIN.items())
                   for m in re.finditer(pattern, text or "") if good(m[0]))
    counts = [sum(s[1] == k for s in spans) for k in range(4)]
    return counts, [s[2] for s in spans]


def agrees(rows, docs):
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows)
    want = sorted((str(i), *plain(t)[0], hashlib.sha256(",".join(plain(t)[1]).encode()).hexdigest()) for i, t in docs)
    assert got == want
    for r in rows:
        texts = [t for i, t in docs if i == r.doc_id]
        assert any(set(plain(t)[1]) <= set(filter(None, r.spans.split(","))) for t in texts)


TEXTS = [
    None, "", "a@b.c_d@e.f x@y", "a.b+c@x-y.z.example.com.", "..@a.b @a.b a@.b", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111x", "+1 (555) 555-7209 +12 3 +123456789 +1 2 3 4 5 6 7 8 9 ()",
    "é梦\U0001f680 mail a@b.de and 10.0.0.1,+49 30 1234567", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1", "9" * 5000,
    "a" * 2000, "a@" * 1000, "1." * 2000, "+1" * 1000, "a.b@c" + ".d" * 2000, "x 4111111111111111 y " * 300,
]
LONG = ["a" * 200000, "a@" * 50000, "1." * 60000, "+1" * 50000, "a.b@c" + ".d" * 50000, "9 " * 100000]


def test_rows(docs_of):
    docs = [*enumerate(TEXTS), (None, TEXTS[2]), (2, TEXTS[2]), (2, "other 1.2.3.4")]
    agrees(pii.personal_data(docs_of(docs)).collect(), docs)
    assert pii.personal_data(docs_of([])).count() == 0
    assert [r.spans for r in pii.personal_data(docs_of([(1, "nothing here")])).collect()] == [""]


def test_very_long_texts(docs_of):
    """Too long for the plain expressions, which take the square of a run's length."""
    got = {r.doc_id: r for r in pii.personal_data(docs_of(list(enumerate(LONG)))).collect()}
    assert [got[i].spans == "" for i in range(6)] == [True, True, False, True, False, True]
    assert got[2].n_ip == 15000 and got[4].spans == f"email:0:{5 + 2 * 50000}"


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    agrees(QUERIES["op1_personal_data"](spark, sf).collect(), docs)


def test_reliable_labelers_are_found(docs_of):
    """Further kinds are reported where the votes say so, and not on look-alikes."""
    docs = [(i, f"Please call {n} or write to a{i}@example.com. Server 10.0.0.{i % 250}, card 4111 1111 1111 1111 and"
             f" phone +1 (212) 555-0{100 + i}.") for i, n in enumerate(["(415) 555-0123", "646 555 0199", "917-555-0142"] * 20)]
    docs += [(100 + i, f"version x{100 + i}-555-0199z and order 0{i:02d}-55-0000 code 1234567890123456 page 000-{i:02d}-1234")
             for i in range(60)]
    got = {r.doc_id: r for r in pii.personal_data(docs_of(docs)).collect()}
    assert all("local_phone" in got[i].spans for i in range(60))
    assert all(got[100 + i].spans == "" for i in range(60))


def test_model_is_bounded_and_learned_from_all_candidates(docs_of):
    found = pii.candidates(docs_of([(i, f"mail a{i}@gmail.com, ip 1.2.3.{i}, card 4111 1111 1111 1112") for i in range(50)]))
    model = pii.train(found).first()
    assert len(model.weights) == len(pii.KINDS) + 3 * pii.LABELERS and len(model.reliability) == 3 * pii.LABELERS + 1
    checksum_no = 3 * 1 + pii.NO
    assert model.reliability[checksum_no] < 0
    n = found.select(F.explode("candidates")).count()
    assert n == 150


def test_plan_is_native(spark):
    df = pii.candidates(table(spark, "/root/testdata/sf0.001", "documents"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_masked_keeps_columns_of_any_name(spark):
    rows = [(1, "mail a@b.de, ip 1.2.3.4", 7, "r"), (2, None, 8, None), (3, "plain", None, "r"), (1, "x" * 100_000 + " a@b.de", 9, "r")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, candidates int, row string")
    got = pii.masked(docs)
    assert got.columns == docs.columns
    want = [(1, "mail [EMAIL], ip [IP]", 7, "r"), rows[1], rows[2], (1, "x" * 100_000 + " [EMAIL]", 9, "r")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
